"""Operators for preparing text corpora: packing, scoring, encoding, licences, rules, search, near copies, pages, urls."""
