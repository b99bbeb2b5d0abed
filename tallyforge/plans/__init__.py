"""Queries over the given tables: one module for each family, with the SQL they are held against."""

from __future__ import annotations

from . import chains, comps, elements, labels, listing_rules, listing_text, markdown, matching, money, performance, replies, reports, selection, sessions, studies

MODULES = (comps, money, matching, sessions, listing_rules, reports, performance, selection, studies, markdown, labels, chains, listing_text, elements, replies)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
