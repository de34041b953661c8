"""Registered queries over the reference's domain."""

from .plans import analysis, catalog, citations, classes, cohort, details, evidence, matching, merges, names, passages

_MODULES = (catalog, analysis, cohort, matching, citations, evidence, classes, names, details, merges, passages)


def _merged(name: str) -> dict:
    out: dict = {}
    for module in _MODULES:
        twice = out.keys() & getattr(module, name)
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= getattr(module, name)
    return out


QUERIES = _merged("QUERIES")
ORACLE_SQL = _merged("ORACLE_SQL")
