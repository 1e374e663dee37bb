"""The search request: eight optional filters, a sort and a page."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sort names with their key column and direction; ids break ties the same way.
SORTS = {
    "reviewCountDesc": ("review_count", False),
    "priceAsc": ("price", True),
    "priceDesc": ("price", False),
    "createdAtDesc": ("created_at", False),
}
MAX_LIMIT = 100
RESULT_WINDOW = 10_050


@dataclass(frozen=True)
class SearchSpec:
    category_id: int | None = None
    brand_id: int | None = None
    status: str | None = None
    min_price: int | None = None
    max_price: int | None = None
    color: str | None = None
    size: str | None = None
    stock_status: str | None = None
    sort: str = "createdAtDesc"
    limit: int = 50
    offset: int = 0

    def validate(self) -> "SearchSpec":
        if not 1 <= self.limit <= MAX_LIMIT:
            raise ValueError(f"limit must be within 1..{MAX_LIMIT}: {self.limit}")
        if self.offset < 0:
            raise ValueError(f"offset must not be negative: {self.offset}")
        for name in ("min_price", "max_price"):
            bound = getattr(self, name)
            if bound is not None and bound < 0:
                raise ValueError(f"{name} must not be negative: {bound}")
        if None not in (self.min_price, self.max_price) and self.min_price > self.max_price:
            raise ValueError("min_price must not exceed max_price")
        if self.sort not in SORTS:
            raise ValueError(f"unsupported sort: {self.sort}")
        return self

    def at(self, **changes) -> "SearchSpec":
        return replace(self, **changes)

    @property
    def option_filters(self) -> dict[str, str]:
        wanted = {"color": self.color, "size": self.size, "stock_status": self.stock_status}
        return {name: value for name, value in wanted.items() if value is not None}

    def product_predicates(self) -> list[Column]:
        """One predicate per given filter; a missing filter adds nothing."""
        found = [
            F.col(name) == value
            for name, value in (
                ("category_id", self.category_id),
                ("brand_id", self.brand_id),
                ("status", self.status),
            )
            if value is not None
        ]
        if self.min_price is not None:
            found.append(F.col("price") >= self.min_price)
        if self.max_price is not None:
            found.append(F.col("price") <= self.max_price)
        return found

    def sort_keys(self) -> tuple[str, bool]:
        return SORTS[self.sort]

    def order(self) -> list[Column]:
        key, ascending = self.sort_keys()
        return [
            F.col(c).asc() if ascending else F.col(c).desc() for c in (key, "id")
        ]
