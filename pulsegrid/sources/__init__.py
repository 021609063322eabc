"""Readers of map, alert and sensor feeds, and writers of exports."""
