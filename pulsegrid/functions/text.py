"""Call-report text as Column expressions.

Patterns stay within what Java's and RE2's regular expressions share: no look-around, no possessive
quantifiers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SHORTEST, LONGEST = 3, 4000
ADVERSARIAL = {
    "instruction_override_attempt": r"\bignore\s+(all\s+)?(previous\s+)?(safety\s+|system\s+|operating\s+|policy\s+)?(rules|instructions|prompts|guidelines)\b",
    "safety_bypass_attempt": r"\b(override|bypass|disable)\s+(all\s+)?(safety|statutory|speed|road|routing|hazard|policy|tunnel|bridge|traffic)\s*(rules|constraints|restrictions|limits)?\b",
    "under_triage_injection": r"\bclassify\s+(this\s+)?(as\s+)?(non-urgent|routine|minor|alpha|bravo|priority\s*4)\b",
    "persona_manipulation": r"\bpretend\s+(you\s+are|to\s+be)\b",
    "jailbreak_probe": r"\b(system\s+prompt|developer\s+mode|jailbreak)\b",
    "dispatch_suppression_attempt": r"\bdo\s+not\s+(dispatch|send|call)\s+(any\s+|an?\s+)?(ambulance|police|fire|first\s+responders)\b",
    "routing_override_attempt": r"\bignore\s+(the\s+)?road\s+(closure|hazard|block)\b",
}
PII = [
    (r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED-SSN]"),
    (r"\b(?:\d{4}[ -]?){3}\d{4}\b", "[REDACTED-CARD]"),
    (r"(?:(?:\+?1[-.\s]?)?\(?\d{3}\)?|\b\d{3})[-.\s]?\d{3}[-.\s]?\d{4}\b", "[REDACTED-PHONE]"),
]
LOCATIONS = [
    r"(?i)\b(?:at|on|near|along)\s+([0-9A-Za-z\s]+(?:Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Drive|Dr|Way|Lane|Ln|Corridor|Highway|Hwy|Expressway))(?:\b|,|\.)",
    r"(?i)\b(?:intersection\s+of|corner\s+of)\s+([0-9A-Za-z\s]+and[0-9A-Za-z\s]+)(?:\b|,|\.)",
    r"(?i)\b([0-9]+\s+[0-9A-Za-z\s]+(?:Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd))(?:\b|,|\.)",
    r"(?i)\b(?:between)\s+([0-9A-Za-z\s]+and[0-9A-Za-z\s]+)(?:\b|,|\.)",
]


def sanitize(text: Column) -> Column:
    """Text without unprintable characters other than line breaks and tabs, stripped."""
    kept = F.regexp_replace(text, r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^\n\t ]]", "")
    return F.regexp_replace(kept, r"^[\s]+|[\s]+$", "")


def sanitize_error(clean: Column, longest: int = LONGEST) -> Column:
    """Error code of sanitized text, null if it can be used."""
    return F.when(clean.isNull() | (F.length(clean) < SHORTEST), "empty_input").when(F.length(clean) > longest, "input_too_long")


def mask_pii(text: Column) -> Column:
    """Social security numbers, then 16-digit cards, then phone numbers replaced by marks."""
    for pattern, mark in PII:
        text = F.regexp_replace(text, pattern, mark)
    return text


def adversarial_flags(text: Column) -> Column:
    """Names of the manipulation patterns found, in their order."""
    low = F.lower(text)
    return F.filter(F.array(*[F.when(low.rlike(p), F.lit(name)) for name, p in ADVERSARIAL.items()]), lambda x: x.isNotNull())


def extract_location(text: Column) -> Column:
    """The first pattern's location of three characters or more, or null."""
    found = [F.trim(F.regexp_replace(F.regexp_extract(text, p, 1), r"^\s+|\s+$", "")) for p in LOCATIONS]
    return F.coalesce(*[F.when(F.length(x) >= 3, x) for x in found])


def extract_json(text: Column) -> Column:
    """struct(json, error): the one fenced block of a model's answer, or what its outer braces hold.

    More than one fence is ambiguous; without a fence or braces there is nothing to read.
    """
    fences = F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*(.*?)\s*```"), F.lit(1))
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    braces = (first > 0) & (F.instr(text, "}") > 0) & (last > first)
    inner = F.when(F.size(fences) == 1, fences[0]).when(braces, text.substr(first, last - first + 1))
    many = F.size(fences) > 1
    return F.struct(F.when(~many, inner).alias("json"), F.when(many, "ambiguous_output").when(inner.isNull(), "no_json").alias("error"))
