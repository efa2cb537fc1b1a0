"""Predicate sets: XML declarations read on the driver into filter expressions."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrat.operators.tables import compare

MEMBRANE = 1


@dataclass(frozen=True)
class Range:
    """Closed. A range with sign "-" never excludes; high < low stands for the outside: (-inf, high) or (low, inf)."""

    low: float
    high: float
    sign: str = "+"

    def test(self, c: Column) -> Column:
        if self.sign != "+":
            return F.lit(True)
        return c.between(self.low, self.high) if self.low <= self.high else (c < self.high) | (c > self.low)


@dataclass(frozen=True)
class Slice:
    """A membrane slice: side, and ranges of eu_dst, geo_dst, geo_len, sin, clst_nv. On the membrane itself distances are not looked at."""

    name: str
    side: int
    ranges: Mapping[str, Range] = field(default_factory=dict)

    def where(self) -> Column:
        out = F.col("side") == self.side
        for k, r in self.ranges.items():
            if self.side != MEMBRANE or k == "clst_nv":
                out = out & r.test(F.col(k))
        return out


@dataclass(frozen=True)
class SynapseSlice:
    """A slice of a synapse: its segment, and ranges of eu_dst, geo_dst, geo_len, sin, clst_nv, all of them looked at."""

    name: str
    segment: int
    ranges: Mapping[str, Range] = field(default_factory=dict)

    def where(self) -> Column:
        out = F.col("segment") == self.segment
        for k, r in self.ranges.items():
            out = out & r.test(F.col(k))
        return out


@dataclass(frozen=True)
class Linker:
    source: str
    target: str
    ranges: Mapping[str, Range] = field(default_factory=dict)

    def where(self) -> Column:
        out = F.lit(True)
        for k, r in self.ranges.items():
            out = out & r.test(F.col(k))
        return out


@dataclass(frozen=True)
class PropertySlice:
    """mode in: in the closed range; out: not in it."""

    key: str
    low: float
    high: float
    mode: str = "in"

    def where(self) -> Column:
        inside = F.col(self.key).between(self.low, self.high)
        return inside if self.mode == "in" else ~inside


def _range(e: ET.Element) -> Range:
    num = lambda tag, default: float(e.find(tag).text) if e.find(tag) is not None else float(e.get(tag, default))
    sign = e.findtext("sign") or e.get("sign", "+")
    return Range(num("low", "-inf"), num("high", "inf"), sign.strip())


def _ranges(e: ET.Element, names: tuple[str, ...]) -> dict[str, Range]:
    return {n: _range(e.find(n)) for n in names if e.find(n) is not None}


def _text(e: ET.Element, tag: str, default: str = "") -> str:
    return (e.findtext(tag) or e.get(tag, default)).strip()


def slices(xml: str) -> list[Slice]:
    return [Slice(_text(e, "name"), int(_text(e, "side", "0")), _ranges(e, ("eu_dst", "geo_dst", "geo_len", "sin", "clst_nv"))) for e in ET.fromstring(xml).iter("mb_slice")]


def synapse_slices(xml: str) -> list[SynapseSlice]:
    return [SynapseSlice(_text(e, "name"), int(_text(e, "segmentation") or _text(e, "segment", "0")), _ranges(e, ("eu_dst", "geo_dst", "geo_len", "sin", "clst_nv"))) for e in ET.fromstring(xml).iter("syn_slice")]


def linkers(xml: str) -> list[Linker]:
    return [Linker(_text(e, "source"), _text(e, "target"), _ranges(e, ("eu_dst", "geo_dst", "sin", "nn"))) for e in ET.fromstring(xml).iter("linker")]


def property_slices(xml: str) -> list[PropertySlice]:
    out = []
    for e in ET.fromstring(xml).iter("thres_slice"):
        v = e.find("value") if e.find("value") is not None else e
        out.append(PropertySlice(_text(e, "key_prop"), _range(v).low, _range(v).high, _text(e, "mode", "in")))
    return out


def thresholds(xml: str) -> Column:
    """All <thresholding> entries (key_prop, operator, threshold) together."""
    out = F.lit(True)
    for e in ET.fromstring(xml).iter("thresholding"):
        out = out & compare(F.col(_text(e, "key_prop")), _text(e, "operator"), float(_text(e, "threshold")))
    return out
