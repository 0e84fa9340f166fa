"""Street-network jobs: collapse, degree, twins, sides, absorption."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions import geometry as g
from tarmac.functions import tags
from tarmac.operators.graph import checkpoint, two_colours
from tarmac.operators.graph import stored as _stored
from tarmac.operators.spatial import _ends, _within, cover, nearest_unbounded

LINK_REASON = "link class"
FRAGMENT_REASON = "unnamed fragment"
#: Pieces of a street name that one task works through at most.
STREET_PIECES = 20_000


def without_limited_access(edges: DataFrame, classes: Sequence[str] = ("motorway", "motorway_link"), names: str = "frontage|feeder|service road") -> DataFrame:
    """Edges of which no class tag is a freeway's and no name that of a frontage road."""
    freeway = F.coalesce(F.arrays_overlap("highway", F.array(*map(F.lit, classes))), F.lit(False))
    frontage = F.coalesce(F.exists("name", lambda n: n.rlike(f"(?i){names}")), F.lit(False))
    return edges.where(~(freeway | frontage))


#: The tags that say something about a side of the street.
SIDEWALK_TAGS = ("sidewalk", "sidewalk:both", "sidewalk:left", "sidewalk:right")
CYCLEWAY_TAGS = ("cycleway", "cycleway:left", "cycleway:right", "cycleway:both")
PARKING_TAGS = ("parking:lane:left", "parking:lane:right", "parking:lane:both", "parking:left", "parking:right", "parking:both")


def normalised_edges(edges: DataFrame, keep: Sequence[str] = ("u", "v", "key")) -> DataFrame:
    """The attributes of an edge table whose tags are lists: one projection that applies every tag rule.

    The columns ``keep``, then ``osmid, name, highway, highway_all, oneway, lanes, maxspeed_mph, width_ft, surface, lit,
    sidewalk, cycleway, parking`` and, if there is a ``geometry``, it and ``length_ft``. A tag that the table lacks, or a
    null or empty list, gives null (``oneway``: true only if tagged so).
    """
    held = set(edges.columns)
    tag = lambda c: F.col(f"`{c}`") if c in held else F.lit(None).cast("array<string>")
    one = lambda c: tags.first_value(tag(c))
    made = {
        "osmid": tags.all_values(tag("osmid")), "name": one("name"), "highway": one("highway"), "highway_all": tags.all_values(tag("highway")),
        "oneway": F.coalesce(tags.flag(one("oneway")), F.lit(False)), "lanes": tags.lanes(one("lanes")), "maxspeed_mph": tags.speed_mph(one("maxspeed")),
        "width_ft": tags.width_feet(one("width")), "surface": one("surface"), "lit": tags.yes_no(tags.flag(one("lit"))),
        "sidewalk": tags.sidewalk_status(*map(one, SIDEWALK_TAGS)), "cycleway": tags.cycleway_status(*map(one, CYCLEWAY_TAGS)), "parking": tags.parking_status(*map(one, PARKING_TAGS)),
    }
    shape = [F.col("geometry"), g.length(F.col("geometry")).alias("length_ft")] if "geometry" in held else []
    return edges.select(*keep, *(c.alias(n) for n, c in made.items()), *shape)


def used_nodes(nodes: DataFrame, edges: DataFrame, node: str = "osmid") -> DataFrame:
    ends = edges.select(F.col("u").alias(node)).unionByName(edges.select(F.col("v").alias(node)))
    return nodes.join(ends.distinct(), node, "left_semi")


def undirected(edges: DataFrame, points: str = "geometry") -> DataFrame:
    """One row for each physical edge: reverse copies collapse, parallel edges of another shape stay."""
    flip = (F.col("u") > F.col("v")) | ((F.col("u") == F.col("v")) & (F.col(points) > F.reverse(points)))
    turned = edges.withColumns({"__u": F.when(flip, F.col("v")).otherwise(F.col("u")), "__v": F.when(flip, F.col("u")).otherwise(F.col("v")), "__g": F.when(flip, F.reverse(points)).otherwise(F.col(points))})
    first = F.row_number().over(Window.partitionBy("__u", "__v", "__g").orderBy("key", "u"))
    return turned.withColumn("__n", first).where("__n = 1").drop("__u", "__v", "__g", "__n")


def node_degrees(edges: DataFrame) -> DataFrame:
    """``node, degree``: ends of edges at each node; a loop counts twice."""
    return edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def with_node_context(edges: DataFrame, signals: DataFrame) -> DataFrame:
    """``deg_u, deg_v, signal_u, signal_v, n_signals``; ``signals``: node."""
    context = node_degrees(edges).join(signals.select("node", F.lit(True).alias("signal")).distinct(), "node", "left").withColumn("signal", F.coalesce("signal", F.lit(False)))
    out = edges
    for end in ("u", "v"):
        out = out.join(context.select(F.col("node").alias(end), F.col("degree").alias(f"deg_{end}"), F.col("signal").alias(f"signal_{end}")), end, "left")
    return out.withColumn("n_signals", F.col("signal_u").cast("int") + F.col("signal_v").cast("int"))


def twin_pairs(lines: DataFrame, reach: float = 150.0, line_id: str = "lid") -> DataFrame:
    """``src, dst`` (src < dst): one-way lines of one name within reach of each other whose chords run opposite ways.

    ``lines``: lid, name, oneway, pieces as x0, y0, x1, y1 and the chord as ax, ay, bx, by (one row a piece).
    """
    own = lines.where("oneway and name is not null")
    cols = [line_id, "name", "x0", "y0", "x1", "y1", "ax", "ay", "bx", "by"]
    chord = lambda s: tuple(F.col(f"{s}_{c}") for c in ("ax", "ay", "bx", "by"))
    side = lambda s, by: cover(own.select(*cols), by, reach).select("cx", "cy", "name", F.col(line_id).alias(f"{s}_{line_id}"), *(F.col(c).alias(f"{s}_{c}") for c in ("ax", "ay", "bx", "by")), *_ends(s))
    met = side("a", 0.0).join(side("b", reach).hint("merge"), ["cx", "cy", "name"]).where((F.col(f"a_{line_id}") < F.col(f"b_{line_id}")) & g.opposed(chord("a"), chord("b")))
    met = _within(met, reach)
    # A pair may touch first in a cell of the one or of the other: the smaller id's own cells meet the larger's inflated ones.
    return met.select(F.col(f"a_{line_id}").alias("src"), F.col(f"b_{line_id}").alias("dst")).distinct()


def two_sides(pairs: DataFrame) -> DataFrame:
    """``node, component, side`` (0 or 1), ``conflict``: the two colours of each component of twins.

    Sides are parities of steps along a spanning tree (``two_colours``), the least node's is 0. A component in which the
    ends of some pair fall on one side has an odd cycle: it is marked as a conflict, and keeps the tree's sides.
    """
    pairs = checkpoint(pairs)
    sides = checkpoint(two_colours(pairs))
    of = lambda end: sides.select(F.col("node").alias(end), F.col("side").alias(f"side_{end}"), *(["component"] if end == "src" else []))
    odd = pairs.where("src <> dst").join(of("src").hint("merge"), "src").join(of("dst").hint("merge"), "dst").where("side_src = side_dst").select("component").distinct()
    return sides.join(odd.withColumn("__odd", F.lit(True)), "component", "left").select("node", "component", "side", F.col("__odd").isNotNull().alias("conflict"))


def representatives(sides: DataFrame, lines: DataFrame, line_id: str = "lid") -> DataFrame:
    """``lid, component, rep_lid``: the lines of each component's shorter side, and the line of the longer side that is
    nearest to their midpoint. Of equally long sides 0 stays. ``lines``: lid, length_ft, pieces, mx, my (midpoint)."""
    info = lines.groupBy(line_id).agg(F.first("length_ft").alias("length_ft"), F.first("mx").alias("mx"), F.first("my").alias("my"))
    placed = checkpoint(sides.join(info.hint("merge"), sides.node == info[line_id]).drop("node"))
    length = placed.groupBy("component", "side").agg(F.round(F.sum("length_ft"), 6).alias("length_ft"))  # sums depend on their order
    kept = length.groupBy("component").agg(F.min_by("side", F.struct(-F.col("length_ft"), "side")).alias("kept"))
    marked = placed.join(kept, "component")
    drops = marked.where("side <> kept").select("component", line_id, "mx", "my")
    reps = marked.where("side = kept").select("component", F.col(line_id).alias("rep_lid"))
    pieces = lines.select(F.col(line_id).alias("rep_lid"), "x0", "y0", "x1", "y1")
    # Midpoints meet the pieces in the cells about them, never all of a component; what is farther is looked for farther off.
    points = drops.select(F.struct("component", line_id).alias("pid"), F.col("mx").alias("px"), F.col("my").alias("py"))
    kept_pieces = reps.join(pieces.hint("merge"), "rep_lid")
    found = nearest_unbounded(points, kept_pieces, 150.0, "pid", "rep_lid", group=("pid.component", "component"))
    return found.select(F.col(f"pid.{line_id}").alias(line_id), "pid.component", "rep_lid")


def merged_attributes(segments: DataFrame, pointers: DataFrame, line_id: str = "lid", prefer: Sequence[str] = ()) -> DataFrame:
    """Representatives with what their dropped halves give: lanes added up (the halves' mean weighted by length), the
    larger speed limit, the first value of ``prefer`` columns where they have none, the halves' ids joined by |."""
    pointers = checkpoint(pointers)
    halves = pointers.join(segments.hint("merge"), line_id)
    known = F.col("lanes").isNotNull()
    got = halves.groupBy("rep_lid").agg(
        (F.sum(F.col("lanes") * F.col("length_ft")) / F.sum(F.when(known, F.col("length_ft")))).alias("lanes_twin_half"),
        F.max("maxspeed_mph").alias("__speed"), F.count("*").alias("n_twins_merged"),
        F.array_join(F.transform(F.array_sort(F.collect_list(line_id)), lambda x: x.cast("string")), "|").alias("twin_ids"),
        *(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(line_id))).alias(f"__{c}") for c in prefer),
    )
    joined = segments.join(pointers.select(line_id).hint("merge"), line_id, "left_anti").join(got.hint("merge"), F.col(line_id) == F.col("rep_lid"), "left")
    merged = F.col("rep_lid").isNotNull()
    return joined.withColumns({
        "merged_dual": merged, "n_twins_merged": F.coalesce("n_twins_merged", F.lit(0)), "lanes_rep_half": F.when(merged, F.col("lanes")),
        "lanes": F.when(merged, F.col("lanes") + F.col("lanes_twin_half")).otherwise(F.col("lanes")),
        "maxspeed_mph": F.greatest("maxspeed_mph", "__speed"), **{c: F.coalesce(c, f"__{c}") for c in prefer},
    }).drop("rep_lid", "__speed", *(f"__{c}" for c in prefer))


def split_by(df: DataFrame, condition, reason: str) -> tuple[DataFrame, DataFrame]:
    """(kept, removed with ``removal_reason``)."""
    met = F.coalesce(condition, F.lit(False))
    return df.where(~met), df.where(met).withColumn("removal_reason", F.lit(reason))


def absorb_short(segments: DataFrame, below: float = 100.0, passes: int = 5, street_pieces: int = STREET_PIECES) -> tuple[DataFrame, DataFrame]:
    """Named pieces shorter than ``below`` go into the longest line of their street that shares an end and is at least as
    long: (segments that stay, pointers ``seg_id, absorbed_into``).

    ``segments``: seg_id, name, u, v, length_ft (other columns stay with their row). A street is worked through in up to
    ``passes`` passes, shortest first (lengths as the pass began), ties by seg_id, always into lines as they are then.
    Streets are independent. Those of up to ``street_pieces`` pieces are groups of one task each (``_street``); larger ones
    are worked through in parallel rounds (``absorb_in_rounds``), with the same result. Unnamed rows stay as they are.
    Only the columns that matter go through the jobs.
    """
    named = segments.where("name is not null").select("seg_id", "name", "u", "v", F.col("length_ft").cast("double").alias("length_ft"))
    kind = {f.name: f.dataType.simpleString() for f in segments.schema.fields}
    schema = f"seg_id {kind['seg_id']}, u {kind['u']}, v {kind['v']}, length_ft double, absorbed_into {kind['seg_id']}"
    large = checkpoint(named.groupBy("name").count().where(F.col("count") > street_pieces).select("name"))
    done = None
    if not large.isEmpty():
        done = absorb_in_rounds(named.join(large, "name", "left_semi"), below, passes)
        named = named.join(large, "name", "left_anti")
    small = named.groupBy("name").applyInPandas(_street(below, passes), schema)
    done = checkpoint(small if done is None else small.unionByName(done))
    stay = done.where("absorbed_into is null").drop("absorbed_into")
    rest = segments.where("name is null")
    updated = segments.drop("u", "v", "length_ft").join(stay, "seg_id").select(segments.columns)
    return updated.unionByName(rest), done.where("absorbed_into is not null").select("seg_id", "absorbed_into")


def _street(below: float, passes: int):
    """The pieces of one street, one after the other."""

    def street(rows: pd.DataFrame) -> pd.DataFrame:
        live = {r.seg_id: [r.u, r.v, r.length_ft] for r in rows.sort_values("seg_id").itertuples()}
        at: dict = {}
        for s, (u, v, _) in live.items():
            for n in (u, v):
                at.setdefault(n, set()).add(s)
        into: dict = {}
        for _ in range(passes):
            short = sorted((x[2], s) for s, x in live.items() if x[2] < below)
            changed = False
            for _, s in short:
                if s not in live:
                    continue
                u, v, size = live[s]
                near = [(live[o][2], o) for o in (at[u] | at[v]) - {s} if live[o][2] >= size]
                if not near:
                    continue
                longest = max(x[0] for x in near)
                best = min(o for d, o in near if d == longest)
                own = live[best]
                ends = sorted({own[0], own[1]} ^ {u, v})
                for n, o in ((u, s), (v, s), (own[0], best), (own[1], best)):
                    at[n].discard(o)
                if len(ends) == 2:
                    own[0], own[1] = ends
                for n in own[:2]:
                    at[n].add(best)
                own[2] += size
                into[s] = best
                del live[s]
                changed = True
            if not changed:
                break
        kept = [(s, u, v, d, None) for s, (u, v, d) in live.items()]
        gone = [(s, None, None, None, o) for s, o in into.items()]
        return pd.DataFrame(kept + gone, columns=["seg_id", "u", "v", "length_ft", "absorbed_into"]).astype(object).where(lambda x: x.notna(), None)

    return street


def absorb_in_rounds(pieces: DataFrame, below: float = 100.0, passes: int = 5) -> DataFrame:
    """``seg_id, u, v, length_ft, absorbed_into`` of named pieces, the order-dependent merge of ``absorb_short`` in rounds.

    What a piece does reads the lines at its ends, and changes one of them: its ends stay among those of the two. So two
    pieces of a pass can only matter to each other while a line has ends in common with both, and a piece may act as soon
    as it is the least (length, seg_id) of all waiting pieces as near as that; those that are act at once. No two of them
    meet in a line, and whatever is less has acted before, as in the sequence. Each round is a few joins by street and node,
    minima first, so neither a long street nor a crowded node gathers in one task. Rounds follow the longest chain of
    falling lengths among neighbouring short pieces; some dozen where lengths are in no order.
    """
    state = _stored(pieces.withColumns({"absorbed_into": F.lit(None).cast(pieces.schema["seg_id"].dataType)}))
    gone = None
    for _ in range(passes):
        turn = F.when(F.col("length_ft") < below, F.struct(F.col("length_ft").alias("size"), F.col("seg_id").alias("of")))
        live = _stored(state.drop("absorbed_into").withColumn("turn", turn))
        acted = False
        while not live.where("turn is not null").isEmpty():
            merges = _stored(_merges(live))
            some = not merges.where("best is not null").isEmpty()
            acted = acted or some
            if some:
                into = merges.where("best is not null").select("seg_id", F.col("best.seg_id").alias("absorbed_into"))
                gone = into if gone is None else gone.unionByName(into)
            live = _stored(_after(live, merges))
        state = live.drop("turn").withColumn("absorbed_into", F.lit(None).cast(pieces.schema["seg_id"].dataType))
        if not acted:
            break
    kept = state.select("seg_id", "u", "v", "length_ft", "absorbed_into")
    return kept if gone is None else kept.unionByName(gone, allowMissingColumns=True)


def _at_ends(live: DataFrame, *columns: str) -> DataFrame:
    return live.select("name", F.explode(F.array_distinct(F.array("u", "v"))).alias("end"), *columns)


def _merges(live: DataFrame) -> DataFrame:
    """``name, seg_id, u, v, length_ft, best``: the pieces whose turn it is, and the line that each goes into, if any."""

    def least(rows: DataFrame, value: str, out: str) -> DataFrame:
        """``rows`` with the least ``value`` among all lines at its two ends."""
        by_end = _at_ends(rows, value).where(f"{value} is not null").groupBy("name", "end").agg(F.min(value).alias("__least"))
        for end in "uv":
            rows = rows.join(by_end.select("name", F.col("end").alias(end), F.col("__least").alias(f"__{end}")), ["name", end], "left")
        return rows.withColumn(out, F.least("__u", "__v")).drop("__u", "__v")

    near = least(least(live, "turn", "next_door"), "next_door", "within_two")
    ready = near.where("turn is not null and turn = within_two").select("name", "seg_id", "u", "v", "length_ft")
    others = _at_ends(live, F.col("seg_id").alias("o"), F.col("length_ft").alias("d"), F.col("u").alias("ou"), F.col("v").alias("ov"))
    met = _at_ends(ready, "seg_id", "length_ft").join(others, ["name", "end"]).where("o <> seg_id and d >= length_ft")
    best = met.groupBy("name", "seg_id").agg(F.min(F.struct((-F.col("d")).alias("less"), F.col("o").alias("seg_id"), "ou", "ov")).alias("best"))
    return ready.join(best, ["name", "seg_id"], "left")


def _after(live: DataFrame, merges: DataFrame) -> DataFrame:
    """The lines after the merges: those that went are out, those that have had their turn have none any more."""
    done = merges.select("seg_id", F.lit(True).alias("done"), F.col("best").isNotNull().alias("went"))
    own, other = F.array("best.ou", "best.ov"), F.array("u", "v")
    ends = F.array_sort(F.array_distinct(F.concat(F.array_except(own, other), F.array_except(other, own))))
    grown = merges.where("best is not null").select(F.col("best.seg_id").alias("seg_id"), ends.alias("ends"), F.col("length_ft").alias("more"))
    held = live.join(done, "seg_id", "left").where("went is null or not went").join(grown, "seg_id", "left")
    two = F.coalesce(F.size("ends") == 2, F.lit(False))
    moved = {"u": F.when(two, F.col("ends")[0]).otherwise(F.col("u")), "v": F.when(two, F.col("ends")[1]).otherwise(F.col("v"))}
    return held.select("seg_id", "name", *(c.alias(k) for k, c in moved.items()), (F.col("length_ft") + F.coalesce("more", F.lit(0.0))).alias("length_ft"), F.when(F.col("done").isNull(), F.col("turn")).alias("turn"))


def follow_pointers(pointers: DataFrame, node: str = "seg_id", to: str = "absorbed_into", rounds: int = 40) -> DataFrame:
    """Each pointer followed to its end, by doubling."""
    held = checkpoint(pointers.select(node, to))
    for _ in range(rounds):
        further = held.select(F.col(node).alias("__at"), F.col(to).alias("__next"))
        moved = checkpoint(held.join(further, held[to] == F.col("__at"), "left").select(node, to, "__next"))
        open_ = moved.where("__next is not null").limit(1).count()
        held = moved.select(node, F.coalesce("__next", to).alias(to))
        if not open_:
            break
    return held


def clean_slivers(segments: DataFrame, away: DataFrame, absorb_below: float = 100.0, drop_below: float = 50.0) -> dict[str, DataFrame]:
    """Links dropped, short named pieces absorbed, short unnamed ones dropped; pointers of ``away`` (lid, rep_seg_id)
    follow. Tables ``segments, removed, away`` (with ``orphan`` where the target was removed)."""
    kept, links = split_by(segments, F.col("highway").endswith("_link"), LINK_REASON)
    kept, into = absorb_short(kept, absorb_below)
    kept, junk = split_by(kept, (F.col("length_ft") < drop_below) & F.col("name").isNull(), FRAGMENT_REASON)
    removed = links.unionByName(junk)
    ends = follow_pointers(into).select(F.col("seg_id").alias("__from"), F.col("absorbed_into").alias("__to"))
    moved = away.join(ends, away.rep_seg_id == F.col("__from"), "left").withColumn("rep_seg_id", F.coalesce("__to", "rep_seg_id")).drop("__from", "__to")
    gone = removed.select(F.col("seg_id").alias("__gone")).distinct()
    moved = moved.join(gone, moved.rep_seg_id == F.col("__gone"), "left").withColumn("orphan", F.col("__gone").isNotNull()).drop("__gone")
    return {"segments": kept, "removed": removed, "away": moved}
