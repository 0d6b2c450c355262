"""Functions from columns to columns: scores, predicates, time bases, wire fields."""
