"""From the levels of several windows to the few zones of a symbol, in two variants.

The first variant snaps zones to bodies of large bars and round numbers and ranks by nearness, the second one keeps the
price a level was seen at and ranks by structure and age. Everything that looks at bars (confirmation by volume, snapping,
means, profile) is done for all symbols at once in Spark; what is left a symbol is a few dozen levels (at most
``3 * 15 + 30`` and the four guaranteed ones), whose rules depend on the order in which zones are taken. They are applied
in one pass over those rows.

Defined cases: a symbol without levels or without a price has no zones; levels farther than 30 % of the price are left out
(50 % when a side has fewer than three zones); a null strength or touch count is 0.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.operators import zones as Z

SIDES = ("support", "resistance")
ZONE = "symbol string, side string, place bigint, price double, low double, high double, key double, tier string, methods bigint, touches bigint, confirmed boolean, role string, note string, score double"
# Shares of the price and multiples of ATR.
HALF_WIDTH, FAR, FARTHEST, SAME, COVERED, CROSS = 0.2, 0.30, 0.50, 0.02, 0.03, 0.02
OVER, KEEP = 9, 3


@dataclass(frozen=True)
class Zone:
    side: str
    mid: float
    key: float
    tier: str
    methods: int
    touches: int
    confirmed: bool
    role: str
    note: str
    age: float


@dataclass(frozen=True)
class Rules:
    """What the two variants differ in."""

    second: bool
    last: float
    atr: float
    bias: float

    def score(self, z: Zone) -> float:
        if not self.second:
            return z.methods * 10 + z.touches + 5 * z.confirmed + 10 * ("flip" in z.role) + 8 * ("CHOCH" in z.role)
        return self._structure(z.role, z.methods, z.touches, z.age, 5.0 * z.confirmed)

    def level_score(self, level: dict) -> float:
        return self._structure(level["role"], level["method"].count("+") + 1, level["touches"], level["age"], 10 * level["strength"])

    @staticmethod
    def _structure(role: str, methods: int, touches: int, age: float, more: float) -> float:
        weight = next((w for word, w in (("CHOCH", 30), ("flip", 25), ("BOS", 10)) if word in role), 0)
        return (weight + 5 * (methods - 1) + min(touches, 5) + more) * max(0.3, math.exp(-max(age, 0.0) / 180))

    def rank(self, z: Zone) -> float:
        if self.second:
            return self.score(z)
        quality = 0.3 * (z.tier == "Major") + 0.2 * ("flip" in z.role) + 0.1 * ("CHOCH" in z.role) + 0.1 * z.confirmed + min(0.15, 0.03 * z.methods)
        return 0.8 / (1 + abs(z.mid - self.last) / self.last) + 0.2 * quality

    def zone(self, level: dict, note: str = "") -> Zone:
        price, side = level["price"], level["side"]
        if self.second:
            anchor, key = price, level["snap"] or price
        else:
            anchor = price if level["wick"] else level["anchor"]
            key = rounded_to(anchor)
        if (key > self.last) if side == "support" else (key < self.last):
            key = price
            if price != self.last:
                side = SIDES[price > self.last]
        methods, role = level["method"].count("+") + 1, level["role"]
        strong = methods >= 2 or level["strength"] >= 0.5 or "flip" in role or "CHOCH" in role or (not self.second and level["touches"] >= 25)
        favoured = (self.bias < -0.5 and side == "resistance" or self.bias > 0.5 and side == "support") and level["touches"] >= 10
        return Zone(side, tier_round(anchor, self.last), key, "Major" if strong or favoured else "Minor", methods, level["touches"], level["confirmed"], role, note, level["age"])

    def merged(self, zones: Iterable[Zone]) -> list[Zone]:
        """Zones of a side chained by steps of an ATR (half of one in the second variant, between the keys)."""
        place = (lambda z: z.key) if self.second else (lambda z: z.mid)
        chains: list[list[Zone]] = []
        for z in sorted(zones, key=lambda z: (place(z), z.mid)):
            if chains and place(z) - place(chains[-1][-1]) <= self.atr * (0.5 if self.second else 1.0):
                chains[-1].append(z)
            else:
                chains.append([z])
        return [self._one(c) if len(c) > 1 else c[0] for c in chains]

    def _one(self, chain: list[Zone]) -> Zone:
        best = max(chain, key=self.score)
        source = best if self.second else max(chain, key=lambda z: z.touches)
        sums = {"methods": max(z.methods for z in chain), "touches": sum(z.touches for z in chain), "confirmed": any(z.confirmed for z in chain)}
        key = source.key
        if not self.second:
            snapped = rounded_to(source.mid)
            key = snapped if snapped != source.mid else key
        mid = tier_round(source.mid, source.mid if self.second else source.key)
        return replace(best, mid=mid, key=key, role=best.role or source.role, age=source.age, **sums)

    def unsandwiched(self, zones: list[Zone]) -> list[Zone]:
        majors = [z.mid for z in zones if z.tier == "Major"]
        if len(zones) < 3 or len(majors) < 2:
            return zones
        beside = lambda m: any(0 < m - k <= self.atr for k in majors) and any(0 < k - m <= self.atr for k in majors)
        return [z for z in zones if z.tier == "Major" or not beside(z.mid)]

    def guarded(self, zones: Iterable[Zone], side: str) -> list[Zone]:
        return [z for z in zones if (z.key < self.last if side == "support" else z.key > self.last)]


def rounded_to(x: float, within: float = 0.003) -> float:
    """First round number of the price's size that lies near, else the price."""
    steps = next((s for least, s in ((1000, (1000, 500, 100, 50)), (100, (100, 50, 10, 5)), (10, (10, 5, 0.5, 0.25)), (1, (0.5, 0.25, 0.1)), (1e-4, (1e-4, 1e-5, 1e-6))) if x >= least), (1e-8, 1e-9, 1e-10))
    return next((v for v in (round(x / s) * s for s in steps) if v > 0 and abs(v - x) / x < within), x)


def tier_round(x: float, size: float) -> float:
    return round(x, next((d for least, d in ((1000, 0), (10, 1), (1, 2), (0.01, 4), (1e-4, 6), (1e-6, 8)) if size >= least), 10))


def across_windows(levels: list[dict], rules: Rules) -> list[dict]:
    """Of levels of one side that lie close, in order of price, one: the most touched, or the best scored one.

    In the first variant the place a later level is compared with moves to the level that was taken; in the second one it
    stays where the first one was.
    """
    taken: list[list] = []
    for level in sorted(levels, key=lambda x: (x["price"], x["side"], x["strength"])):
        near = (lambda p: abs(level["price"] - p) < 0.4 * rules.atr) if rules.second else (lambda p: p > 0 and abs(level["price"] - p) / p < SAME)  # noqa: B023
        found = next((t for t in taken if t[0]["side"] == level["side"] and near(t[1])), None)
        if found is None:
            taken.append([level, level["price"]])
        elif rules.second and rules.level_score(level) > rules.level_score(found[0]):
            found[0] = level
        elif not rules.second and (level["touches"], level["strength"]) > (found[0]["touches"], found[0]["strength"]):
            found[:] = [level, level["price"]]
    return [t[0] for t in taken]


def zones_of(levels: list[dict], last: float, atr: float, bias: float, second: bool = False) -> list[Zone]:
    """Zones of one symbol from its levels: ``kind`` (window, full, poc, sma_*), price, side, strength, method, touches,
    role, wick, anchor, snap, age, confirmed. Each side from the nearest on."""
    rules = Rules(second, last, atr, bias)
    near = lambda p, prices, within: any(abs(q - p) / max(q, 1e-12) < within for q in prices)
    raw = across_windows([x for x in levels if x["kind"] == "window"], rules)
    poc = next((x for x in levels if x["kind"] == "poc"), None)
    if poc and not near(poc["price"], [x["price"] for x in raw], SAME):
        raw.append(poc | {"strength": 0.45})
    found = [rules.zone(x) for x in raw if abs(x["price"] - last) <= FAR * last]
    sides = {}
    for side in SIDES:
        own = rules.unsandwiched(rules.merged(z for z in found if z.side == side))
        sides[side] = sorted(own, key=lambda z: (-rules.rank(z), z.mid))[:OVER]
    covered = lambda p, side: any(abs(z.mid - p) / p < COVERED for z in sides[side])
    if poc and poc["price"] < last and not covered(poc["price"], "support"):
        sides["support"] = sides["support"][: OVER - 1] + [rules.zone(poc | {"strength": 0.40}, "Volume POC")]
    for x in (x for x in levels if x["kind"].startswith("sma")):
        side = SIDES[x["price"] >= last]
        if 0.01 <= abs(x["price"] - last) / last <= 0.20 and not covered(x["price"], side):
            sides[side] = [*sides[side], rules.zone(x, x["kind"].replace("sma_", "SMA "))]
    sides = {s: rules.guarded(rules.merged(zs), s) for s, zs in sides.items()}
    if min(map(len, sides.values())) < KEEP:
        known = [z.mid for zs in sides.values() for z in zs]
        more = []
        for x in sorted((x for x in levels if x["kind"] == "full"), key=lambda x: (abs(x["price"] - last), x["price"])):
            if all(abs(x["price"] - p) >= atr for p in known) and (x["strength"] >= 0.10 or x["touches"] >= 3) and abs(x["price"] - last) <= FARTHEST * last:
                more.append(rules.zone(x))
                known.append(more[-1].mid)
        sides = {s: rules.guarded(rules.merged([*zs, *rules.guarded((z for z in more if z.side == s), s)]), s) for s, zs in sides.items()}
    away = lambda z: (abs(z.mid - last), z.mid)
    if not second:
        sides = {s: sorted(zs, key=away)[:KEEP] for s, zs in sides.items()}
    # of a support and a resistance too close to each other the better one stays
    close = (lambda s, r: abs(s.mid - r.mid) < 0.5 * atr) if second else (lambda s, r: abs(s.mid - r.mid) / max(s.mid, 1e-12) < CROSS)
    pairs = [(s, r) for s in sides["support"] for r in sides["resistance"] if close(s, r)]
    gone = {id(r) if rules.score(s) >= rules.score(r) else id(s) for s, r in pairs}
    sides = {s: [z for z in zs if id(z) not in gone] for s, zs in sides.items()}
    if second:
        final = lambda z: (-(0.8 / (1 + abs(z.mid - last) / last) + 0.2 * rules.score(z) / 80), z.mid)
        for s, zs in sides.items():
            taken = sorted(rules.guarded(zs, s), key=away)[:1]
            for z in sorted((z for z in rules.guarded(zs, s) if z not in taken), key=final):
                if len(taken) < KEEP and all(abs(z.mid - t.mid) >= 0.75 * atr for t in taken):
                    taken.append(z)
            sides[s] = taken
    return [z for s in SIDES for z in sorted(sides[s], key=away)]


def candidates(windows: DataFrame, full: DataFrame, outlook: DataFrame, area: DataFrame) -> DataFrame:
    """All levels the zones may come from: of the windows, of the whole series, the point of control and three means.

    ``windows`` and ``full``: ``symbol, price, side, strength, method, touches, role, wick, snap, age``; the strengths of
    windows carry their weights.
    """
    columns = ["symbol", "price", "side", "strength", "method", "touches", "role", "wick", "snap", "age"]
    own = windows.select("kind", *columns).unionByName(full.select("kind", *columns)) if "kind" in windows.columns else (
        windows.select(F.lit("window").alias("kind"), *columns).unionByName(full.select(F.lit("full").alias("kind"), *columns))
    )
    facts = outlook.join(area.select("symbol", "poc"), "symbol", "left")
    extra = F.array(
        F.struct(F.lit("poc").alias("kind"), F.col("poc").alias("price"), F.lit("volume_profile").alias("method"), F.lit(0.45).alias("strength")),
        *(F.struct(F.lit(f"sma_{k}").alias("kind"), F.col(f"sma_{k}").alias("price"), F.lit("touch_count").alias("method"), F.lit(0.35).alias("strength")) for k in (50, 100, 200)),
    )
    more = facts.select("symbol", "last", F.explode(extra).alias("x")).where("x.price is not null").select(
        "x.kind", "symbol", "x.price", F.when(F.col("x.price") < F.col("last"), "support").otherwise("resistance").alias("side"), "x.strength", "x.method", F.lit(0).cast("bigint").alias("touches"),
        F.lit("").alias("role"), F.lit(False).alias("wick"), F.lit(None).cast("double").alias("snap"), F.lit(0.0).alias("age"),
    )
    return own.unionByName(more)


def zones(levels: DataFrame, bars: DataFrame, atr: DataFrame, outlook: DataFrame, second: bool = False) -> DataFrame:
    """Zones of every symbol with their place from the price on each side; ``levels`` as of :func:`candidates`."""
    confirmed = Z.volume_confirmed(levels, bars, atr)
    anchors = Z.body_anchors(levels.select("symbol", "price", "side").distinct(), bars, atr).select("symbol", "price", "side", "anchor")
    facts = outlook.select("symbol", "last", "bias").join(atr, "symbol").where("last > 0")
    rows = confirmed.join(anchors, ["symbol", "price", "side"], "left").join(facts, "symbol")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        last, atr_, bias = (float(pdf[c].iloc[0]) for c in ("last", "atr", "bias"))
        clean = pdf.assign(
            strength=pdf["strength"].fillna(0.0), touches=pdf["touches"].fillna(0).astype(int), role=pdf["role"].fillna(""), anchor=pdf["anchor"].fillna(pdf["price"]),
            snap=pdf["snap"].fillna(0.0), age=pdf["age"].fillna(0.0), wick=pdf["wick"].fillna(False).astype(bool), confirmed=pdf["confirmed"].fillna(False).astype(bool),
        )
        out, place = [], dict.fromkeys(SIDES, 0)
        rules, half = Rules(second, last, atr_, bias), HALF_WIDTH * atr_
        for z in zones_of(clean.to_dict("records"), last, atr_, bias, second):
            place[z.side] += 1
            out.append((key[0], z.side, place[z.side], z.mid, tier_round(z.mid - half, last), tier_round(z.mid + half, last), z.key, z.tier, z.methods, z.touches, z.confirmed, z.role, z.note, float(rules.score(z))))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ZONE.split(", ")])

    return rows.groupBy("symbol").applyInPandas(run, ZONE)


def scenarios(zones: list[Zone], last: float, atr: float) -> dict[str, dict[str, float]]:
    """Prices to watch: what holds and fails, where targets and stops lie. Keys without ground are left out.

    A support nearer than 2 % gives way to the next one as the one to hold, and so does a target.
    """
    close = 0.02 * last
    supports = sorted((z for z in zones if z.side == "support"), key=lambda z: -z.mid)
    above = sorted((z for z in zones if z.side == "resistance"), key=lambda z: z.mid)
    at = int(len(supports) > 1 and abs(last - supports[0].key) < close) if supports else 0
    hold = supports[at] if supports else None
    beyond = supports[1 : 3] if at == 0 else supports[2 : 3]
    second, third = (beyond + [None, None])[:2] if at == 0 else ((beyond + [None])[0], None)
    majors = [z for z in above if z.tier == "Major"]
    if not majors:
        targets = above[:2]
    elif above[0].tier == "Minor" and abs(majors[0].mid - last) / last > 0.15:
        targets = [above[0], majors[0]]
    else:
        targets = majors[:2]
    if targets and abs(targets[0].key - last) < close:
        targets = targets[1:2]
    low = lambda z: z.mid - HALF_WIDTH * atr
    key = lambda z: z.key if z else None
    end = key(second) if second else low(hold) if hold else None
    floor = low(second) if second else low(hold) if hold else None
    reopened = key(third) if third else low(second) if second else None
    far = next((z for z in above if z.key > 1.02 * last), targets[0] if targets else None)
    found = {
        "bullish": {"hold_above": key(hold), "next_target": key(targets[0]) if targets else None, "extended_target": key(targets[1]) if len(targets) > 1 else None, "invalidation": end},
        "bearish": {"fails_at": key(hold), "retests": key(second), "reopens": reopened},
        "triggers": {"buy_the_dip": key(hold), "stop_loss": floor, "take_profit": key(far)},
    }
    return {k: {name: tier_round(v, last) for name, v in part.items() if v is not None} for k, part in found.items()}


def documents(zones_: DataFrame, outlook: DataFrame, atr: DataFrame, area: DataFrame) -> DataFrame:
    """``symbol, document``: one JSON object a symbol with its structure, zones of either side from the nearest, scenarios,
    triggers and value area. ``zones_`` as of :func:`zones`, at most a handful of rows a symbol."""
    facts = outlook.join(atr, "symbol").join(area.select("symbol", "poc", F.col("low").alias("val"), F.col("high").alias("vah")), "symbol", "left").where("last > 0")
    rows = facts.join(zones_, "symbol", "left")
    means = [c for c in outlook.columns if c.startswith("sma_")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        number = lambda v: None if pd.isna(v) else float(v)
        last, atr_ = float(head["last"]), float(head["atr"])
        own = [Zone(r.side, r.price, r.key, r.tier, int(r.methods), int(r.touches), bool(r.confirmed), r.role or "", r.note or "", 0.0) for r in pdf.dropna(subset=["side"]).itertuples()]
        listed = {
            side: [
                {"zone": [tier_round(z.mid - HALF_WIDTH * atr_, last), tier_round(z.mid + HALF_WIDTH * atr_, last)], "key_level": tier_round(z.key, last), "tier": z.tier,
                 "distance_pct": round(abs(z.mid - last) / last * 100, 1), "confluence": z.methods, "touches": z.touches, "volume_confirmed": z.confirmed, "notes": z.note or None}
                for z in sorted((z for z in own if z.side == side), key=lambda z: abs(z.mid - last))
            ]
            for side in SIDES
        }
        plan = scenarios(own, last, atr_)
        document = {
            "symbol": key[0], "price": tier_round(last, last), "data_points": int(head["bars"]),
            "market_structure": {"trend": head["trend"], "structure": head["structure"], "bias": float(head["bias"]), "atr14": round(atr_, 8)} | {c.replace("_", ""): number(head[c]) for c in means},
            **listed, "scenarios": {k: plan[k] for k in ("bullish", "bearish")}, "triggers": plan["triggers"],
            "volume_profile": {"poc": number(head["poc"]), "value_area_low": number(head["val"]), "value_area_high": number(head["vah"])},
        }
        return pd.DataFrame({"symbol": [key[0]], "document": [json.dumps(document)]})

    return rows.groupBy("symbol").applyInPandas(run, "symbol string, document string")
