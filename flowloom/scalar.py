"""One flow as a Python value, for literals and displays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

Point = tuple[float, ...]


@dataclass(frozen=True, init=False)
class Flow:
    """An ordered pair of points (two or three numbers each); Flow(None) is empty."""

    points: tuple[Point, ...]

    def __init__(self, od_points: Flow | Sequence[Sequence[float]] | None = None) -> None:
        if isinstance(od_points, Flow):
            points = od_points.points
        elif od_points is None:
            points = ()
        else:
            if any(isinstance(p, (int, float, str)) or not isinstance(p, Sequence) for p in od_points):
                raise ValueError("a flow is made of points, not of numbers")
            points = tuple(tuple(map(float, p)) for p in od_points)
            if len(points) != 2 or any(len(p) not in (2, 3) for p in points):
                raise ValueError("a flow has two points of two or three coordinates")
        object.__setattr__(self, "points", points)

    def __iter__(self) -> Iterator[Point]:
        """The points in the plane, as every computation takes them."""
        return iter([p[:2] for p in self.points])

    def __len__(self) -> int:
        return len(self.points)

    @property
    def is_empty(self) -> bool:
        return not self.points

    @property
    def o(self) -> Point:
        return self.points[0]

    @property
    def d(self) -> Point:
        return self.points[1]

    @property
    def wkt(self) -> str:
        return "FLOW EMPTY" if self.is_empty else "FLOW (" + ", ".join(f"{p[0]} {p[1]}" for p in self.points) + ")"

    def __str__(self) -> str:
        return self.wkt

    @property
    def __geo_interface__(self) -> dict:
        return {"type": "Flow", "coordinates": self.points}

    def svg(self, scale_factor: float = 1.0, fill_color: str | None = None, opacity: float | None = None) -> str:
        """Two circles, for notebooks."""
        if self.is_empty:
            return "<g />"
        fill, fade = fill_color or "#66cc99", 0.6 if opacity is None else opacity
        circles = (f'<circle cx="{p[0]}" cy="{p[1]}" r="{3.0 * scale_factor}" stroke="#555555" stroke-width="{1.0 * scale_factor}" fill="{fill}" opacity="{fade}" />' for p in self.points)
        return "<g>" + "".join(circles) + "</g>"
