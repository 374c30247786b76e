"""Modules that register queries: each instantiates operators over the given tables."""

from quarry.plans import audits, callables, code, contexts, detect, dup, failures, flow, graphs, headline, locales, markup, pages, rules, scans, scores, shapes, tables, texts, webpages  # noqa: F401
