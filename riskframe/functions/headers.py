"""Header resolution: one declarative table of signatures, matched against column names only."""
from __future__ import annotations

import re
from dataclasses import dataclass

from .constants import ACTIVITY_DOMAIN_COLUMNS, ALIASES, CANONICAL_COLS


def header_key(name) -> str:
    """Spelling-independent form of a header: letters and digits, lower case."""
    return re.sub(r"[\W_]+", "", str(name)).lower()


@dataclass(frozen=True)
class Signature:
    """A table of ``kind`` has every column of ``every`` and, if given, one of ``some``."""
    kind: str
    every: frozenset
    some: frozenset = frozenset()

    def matches(self, names: frozenset) -> bool:
        return self.every <= names and (not self.some or not self.some.isdisjoint(names))


def _sig(kind, every, some=()):
    return Signature(kind, frozenset(every.split()), frozenset(some))


# What identifies each kind of table, in order of precedence.
UPLOADS = (
    _sig("lab", "markercode value"),
    _sig("activity", "stepcount", map(header_key, ACTIVITY_DOMAIN_COLUMNS)),
    _sig("roster", "employeeid age"),
)
DATASETS = (
    _sig("underwriting_tabular", "applicant_age gender occupation_risk health_score bmi "
                                 "smoker previous_claims_count coverage_amount premium_calculated"),
    _sig("insurance_charges", "age bmi children sex smoker region prediction"),
    _sig("company_profiles", "name industry followers_count associated_members_count founded_on"),
    _sig("clinical_notes", "text"),
)


def kind_of(names, signatures, key=str) -> str | None:
    """Kind of the first signature that the column names match."""
    have = frozenset(map(key, names))
    return next((s.kind for s in signatures if s.matches(have)), None)


#: Canonical column of every accepted header spelling.
_CANONICAL = {header_key(spelling): canon for canon in CANONICAL_COLS for spelling in (canon, *ALIASES.get(canon, ()))}


def canonical_headers(names) -> dict[str, str]:
    """Source header -> canonical column; of several headers for one column the first is taken."""
    taken: dict[str, str] = {}
    for name in names:
        if canon := _CANONICAL.get(header_key(name)):
            taken.setdefault(canon, name)
    return {name: canon for canon, name in taken.items()}
