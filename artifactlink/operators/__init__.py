"""Relational operators: fingerprints, candidates, scores, decisions, graph passes, members, audits, mappings."""
