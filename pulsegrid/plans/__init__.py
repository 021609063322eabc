"""Plans that chain operators, and the registered queries."""
