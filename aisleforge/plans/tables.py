"""Rule tables, keyword catalogues and maps used by the registered queries (our own values)."""

from __future__ import annotations

from ..operators.rules import Rule

CATALOG = [
    Rule("Hardware", ("bolt", "gear", "ring", "plate", "spanner")),
    Rule("Gadgets", ("gizmo", "widget", "small gizmo")),
    Rule("Heavy Goods", ("anvil", "large", "hammer")),
    Rule("Warm Goods", ("hot", "red", "warm", "fire")),
]
CASCADE = [*CATALOG, Rule("Cold Goods", ("col", "frozen", "icy"))]
#: discovered clusters as (name, confidence, product types)
CLUSTERS = [("Old Stock", 0.7, ("old rod", "old ring")), ("Plates", 0.8, ("plate blue", "new plate"))]
REPAIRS = [Rule("Fasteners", ("bolt", "ring")), Rule("Machines", ("gear", "gizmo", "widget")), Rule("Heavy", ("anvil", "plate"))]
STANDARD = {"ECONOMY": "Value", "LARGE": "Bulk", "MEDIUM": "Regular", "SMALL": "Regular", "PROMO": "Promotions", "Value": "Value", "Bulk": "Bulk", "Regular": "Regular", "Promotions": "Promotions", "Other Products": "Other Products"}
CONSOLIDATED = {"ECONOMY": "Everyday", "SMALL": "Everyday", "MEDIUM": "Everyday", "LARGE": "Special", "PROMO": "Special"}
FIXED_CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "Other Products", "Beverages", "Household"]
BRANDS = [("Brand#1", "local"), ("Brand#2", "local"), ("Brand#13", "local"), ("Brand#20", "international"), ("Brand#24", "international")]
