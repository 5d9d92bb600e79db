"""Column-role resolution over a schema's names (no data is touched).

A role is found by scanning the column names in order and keeping those
whose lower-cased name contains any of the role's keywords.  Callers take
either the first hit or all hits.  An explicit override map always wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from .. import constants as K


def find_columns(columns: Iterable[str], keywords: Sequence[str]) -> list[str]:
    """All names (in schema order) whose lower-cased text contains a keyword."""
    out = []
    for c in columns:
        low = str(c).lower()
        if any(k in low for k in keywords):
            out.append(c)
    return out


def first_column(columns: Iterable[str], keywords: Sequence[str]) -> str | None:
    hits = find_columns(columns, keywords)
    return hits[0] if hits else None


#: Roles of the order-table profile, most specific first.
PROFILE_ROLES = (("sku", K.KW_ORDER_SKU), ("amount", K.KW_ORDER_AMOUNT_PROFILE),
                 ("status", K.KW_ORDER_STATUS_PROFILE), ("shop", K.KW_SHOP_PROFILE))


def profile_role(column: str) -> str | None:
    """The first profile role one of whose words the column's name contains."""
    return next((role for role, words in PROFILE_ROLES if find_columns([column], words)), None)


@dataclass(frozen=True)
class OrderRoles:
    """Roles of the order-line table used by cleaning."""

    order_id: str | None
    amount: str | None
    mark: str | None
    statuses: tuple[str, ...]
    shop: str | None

    @classmethod
    def resolve(cls, columns: Sequence[str],
                overrides: Mapping[str, object] | None = None) -> "OrderRoles":
        o = dict(overrides or {})
        statuses = o.get("statuses")
        return cls(
            order_id=o.get("order_id", first_column(columns, K.KW_ORDER_ID)),
            amount=o.get("amount", first_column(columns, K.KW_CLEAN_AMOUNT)),
            mark=o.get("mark", first_column(columns, K.KW_MARK)),
            statuses=tuple(statuses) if statuses is not None
            else tuple(find_columns(columns, K.KW_STATUS)),
            shop=o.get("shop", first_column(columns, K.KW_SHOP)),
        )


@dataclass(frozen=True)
class MarginRoles:
    """Roles used by the margin step, resolved on the two input schemas.

    ``merged`` is the order columns followed by the product columns, the
    column order of a left join, so "first" means order side first.
    """

    cost: str | None
    quantity: str | None
    revenue: str | None
