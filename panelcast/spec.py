"""The key vocabulary every operator is parameterised by."""

from __future__ import annotations

from dataclasses import dataclass, replace

ROLES = ("identity", "context", "outcome", "derived")


@dataclass(frozen=True)
class PanelSpec:
    """Which columns of a panel play which part.

    A panel has one row per (group, entity, event). Several events of one entity can fall
    in the same period; features are lagged at the period boundary, never at the row.
    """

    group: tuple[str, ...] = ("season",)
    entity: str = "entity"
    period: str = "period"
    event: str = "event"
    time: str = "ts"
    side: str = "side"
    opponent: str = "opponent"
    home: str = "is_home"

    @property
    def keys(self) -> list[str]:
        return [*self.group, self.entity]

    @property
    def period_keys(self) -> list[str]:
        return [*self.keys, self.period]

    @property
    def order(self) -> list[str]:
        """Order of the rows inside one group-entity: what "before" means."""
        return [self.period, self.time, self.event]

    def for_side(self) -> "PanelSpec":
        """The same panel seen at side level: the side takes the place of the entity."""
        return replace(self, entity=self.side)
