"""The agencies of the driver's queries: configuration of all kinds, and the SQL rows that it resolves to."""

from __future__ import annotations

AGENCIES = [
    {"code": "75", "name": "FRANCE", "short": "FR", "award_types": ["C"], "award_amount_min": 25000, "seed_strategy": "archive"},
    {"code": "097", "name": "CHINA", "short": "CN", "award_types": ["A", "B", "C", "D"]},
    {"code": "12", "name": "BRAZIL", "short": "BR", "award_types": ["D"], "award_amount_min": 0},
    {"code": "1234", "name": "NOWHERE", "short": "NW", "award_types": []},
    {"code": "70", "name": "NATION_0", "short": "N0", "award_types": ["C"], "award_amount_min": 25000, "seed_strategy": "archive"},
    {"code": "089", "name": "NATION_7", "short": "N7", "award_types": ["D"]},
    {"code": "9700", "name": "NATION_15", "short": "N15", "award_types": []},
]
DEFAULTS = {"award_types": ["A", "B", "C", "D"], "award_amount_min": 0, "seed_strategy": "paginate"}
YEARS = [1999, 2000]

POLICY_ROWS = (
    "policy(name, short, types, least, mode) AS (VALUES ('FRANCE', 'FR', ['DELIVERY ORDER'], 25000.0, 'archive'), ('CHINA', 'CN', NULL, 0.0, 'paginate'), "
    "('BRAZIL', 'BR', ['DEFINITIVE CONTRACT'], 0.0, 'paginate'), ('NOWHERE', 'NW', NULL, 0.0, 'paginate'), "
    "('NATION_0', 'N0', ['DELIVERY ORDER'], 25000.0, 'archive'), ('NATION_7', 'N7', ['DEFINITIVE CONTRACT'], 0.0, 'paginate'), ('NATION_15', 'N15', NULL, 0.0, 'paginate'))"
)
