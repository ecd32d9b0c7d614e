"""Tree of shared beginnings of the areas' season histories.

Histories are sorted, so those that begin alike are neighbours. Union-find over the lengths of the beginnings that
neighbours share, longest first, makes a node wherever components merge. Every range of the order is done by itself; what
its outermost histories share with the next range is contracted to partial nodes, which are merged by their beginning.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from embergrid.llm.records import arrow_step
from embergrid.session import materialize

ID_BLOCK = 4096  # areas whose numbers share a quotient by this are listed together
SEASONS_PER_RANGE = 200_000  # that a task holds at once
NOTHING = sha256(b"").hexdigest()


def season_marks(reports: DataFrame) -> DataFrame:
    """(area, start_year, mark, chars): season reports (area, start_year, label, document) without their texts.

    The mark is the MD5 of label and document; null ones count as empty. Rows without an area belong to no history and are left out.
    """
    label, text = (F.coalesce(F.col(c), F.lit("")) for c in ("label", "document"))
    return reports.filter(F.col("area").isNotNull()).select(
        "area", "start_year", F.unhex(F.md5(F.concat(F.octet_length(label).cast("string"), F.lit(":"), label, text))).alias("mark"),
        F.length(text).cast("bigint").alias("chars"),
    )


def _shared(a: list, b: list) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


class _Part:
    """Union-find over one range of sorted, distinct histories; rows of the finished nodes.

    A component stands for the node that all its histories share most deeply. It is kept at its root: depth of the node
    not yet written, first history, number of areas, smallest area, new children of that node, leaves, and the two
    sums below it: areas x characters over all its nodes, characters over the nodes that no earlier range has.
    """

    def __init__(self, rows: list[dict], before: int, after: int):
        self.rows, self.before, self.after = rows, before, after  # lengths shared with the ranges on either side; -1: none there
        self.root = list(range(len(rows)))
        self.last = list(range(len(rows)))
        self.out: list[list] = []
        self.waiting: dict[int, list[int]] = {}  # component -> its written nodes whose parent isn't written
        self.shared = [_shared(a["marks"], b["marks"]) for a, b in zip(rows, rows[1:])]
        following = [*self.shared, after]
        self.state = [
            [len(r["marks"]), i, r["n"], r["least"], 0, int(following[i] < len(r["marks"]) or following[i] < 0), 0, 0]
            for i, r in enumerate(rows)
        ]

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def write(self, i: int, down_to: int) -> None:
        """Write the nodes of a component that lie deeper than ``down_to``."""
        depth, first, n, least, kids, leaves, total, new_chars = self.state[i]
        row = self.rows[first]
        left, right = first == 0, self.last[i] == len(self.rows) - 1
        while depth > down_to:
            new = not (left and depth <= self.before)
            chars = row["chars"][depth - 1] if depth else 0
            total += n * chars
            new_chars += chars * new
            is_open = not new or (right and depth <= self.after)
            ends = row["ends"] if depth == len(row["marks"]) else None
            at = len(self.out)
            self.out.append([least, depth, None, None, (first, depth) if is_open else None, n, kids, leaves, total, new_chars, ends])
            for child in self.waiting.pop(i, ()):
                if is_open:
                    self.out[child][3] = (first, depth)
                else:
                    self.out[child][2] = least
            self.waiting[i] = [at]
            kids, depth = int(new), depth - 1
        self.state[i] = [depth, first, n, least, kids, leaves, total, new_chars]

    def merge(self, i: int, j: int, depth: int) -> None:
        """Components i and j, neighbours in this order, meet in a node at ``depth``."""
        self.write(i, depth)
        self.write(j, depth)
        a, b = self.state[i], self.state[j]
        a[2:] = a[2] + b[2], min(a[3], b[3]), *(x + y for x, y in zip(a[4:], b[4:]))
        self.root[j] = i
        self.last[i] = self.last[j]
        self.waiting.setdefault(i, []).extend(self.waiting.pop(j, ()))

    def nodes(self) -> list[list]:
        for at in sorted(range(len(self.shared)), key=lambda k: -self.shared[k]):
            self.merge(self.find(at), self.find(at + 1), self.shared[at])
        self.write(self.find(0), -1)
        wanted: dict[int, set[int]] = {}
        for row in self.out:
            for name in row[3:5]:
                if name:
                    wanted.setdefault(name[0], set()).add(name[1])
        named = {(first, d): key for first, depths in wanted.items() for d, key in _names(self.rows[first]["marks"], depths)}
        for row in self.out:
            row[3], row[4] = named.get(row[3]), named.get(row[4])
        return self.out


def _names(marks: list[bytes], depths: set[int]) -> Iterator[tuple[int, bytes]]:
    """(depth, digest of that many marks), one name for a beginning wherever it is met."""
    upto = md5()
    for d in range(max(depths) + 1):
        if d:
            upto.update(marks[d - 1])
        if d in depths:
            yield d, upto.copy().digest() + d.to_bytes(4, "big")


_NODE = "area bigint, depth bigint, parent_area bigint, parent_key binary, key binary, n_areas bigint, n_children bigint, n_leaves bigint, " \
    "all_chars bigint, new_chars bigint, ends string"
_NODE_ARROW = pa.schema([
    ("area", pa.int64()), ("depth", pa.int64()), ("parent_area", pa.int64()), ("parent_key", pa.binary()), ("key", pa.binary()),
    *((c, pa.int64()) for c in ("n_areas", "n_children", "n_leaves", "all_chars", "new_chars")), ("ends", pa.string()),
])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part and place -> nodes of each part."""

    def finished(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        if rows:
            first, last = rows[0], rows[-1]
            before = -1 if first["before"] is None else _shared(first["before"], first["marks"])
            after = -1 if last["after"] is None else _shared(last["marks"], last["after"])
            made = _Part(rows, before, after).nodes()
            for at in range(0, len(made), 10_000):
                columns = zip(*made[at : at + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _NODE_ARROW.types)], schema=_NODE_ARROW)

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[-1]["part"] != row["part"]:
                yield from finished(held)
                held = []
            held.append(row)
    yield from finished(held)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of (name, ids in text) in order -> (name, SHA-256 of the texts joined by commas), in constant memory."""
    name, upto = None, None
    done: tuple[list, list] = ([], [])

    def finish() -> None:
        done[0].append(name)
        done[1].append(upto.hexdigest())

    for batch in batches:
        for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if one != name:
                if upto is not None:
                    finish()
                name, upto = one, sha256(text.encode())
            else:
                upto.update(b"," + text.encode())
        if done[0]:
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1])], names=["name", "many"])
            done = ([], [])
    if upto is not None:
        finish()
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1])], names=["name", "many"])


def _ends(histories: DataFrame, several: DataFrame) -> DataFrame:
    """(name, many): digest of the areas that share a whole history, for those that several share.

    Ids are joined in blocks of at most ``ID_BLOCK`` first, so the digest, which can only be made in order, passes
    over one row for each block.
    """
    members = histories.join(several.select("name"), "name", "left_semi")
    blocks = members.groupBy("name", F.floor(F.col("area") / ID_BLOCK).alias("block")).agg(
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list("area")), lambda x: x.cast("string"))).alias("ids")
    )
    ordered = blocks.repartition("name").sortWithinPartitions("name", "block").select("name", "ids")
    return arrow_step(ordered, _digests, "name binary, many string")


def history_tree(marks: DataFrame, areas: DataFrame) -> DataFrame:
    """One row for each beginning that some area's history of season marks (area, start_year, mark, chars) has: area (the
    smallest one with it), depth (its number of seasons), parent_area (the same of the beginning that is one season shorter;
    null for the root), n_areas, n_children, n_leaves (ends below it), saved_chars (characters that need not be stored
    again: over all beginnings that contain it, each one's areas less one times its last report's length) and ends_sha256 (digest of the
    areas whose history ends here, in ascending order, joined by commas; without any, that of nothing).

    Seasons are ordered by start_year, a null one first, ties by their mark; repeated rows stay. ``areas`` (area) lists
    the histories, areas without any season included; an area that is only in ``marks`` counts too. Areas are whole numbers;
    null ones are left out. No area at all: no row. A history travels as one row of 24 bytes a season, without its texts, however
    long these are. Other columns are ignored, whatever their names.

    Equal histories collapse to one row before the order is made, so a history that a third of all areas share is a
    count; a beginning that many share is spread over ranges by what follows.
    """
    seasons = marks.filter(F.col("area").isNotNull()).groupBy(F.col("area").cast("bigint").alias("area")).agg(
        F.sort_array(F.collect_list(F.struct(
            F.col("start_year").isNotNull().alias("dated"), "start_year", "mark", "chars",
        ))).alias("seasons")
    )
    known = areas.filter(F.col("area").isNotNull()).select(F.col("area").cast("bigint").alias("area")).distinct()
    histories = known.join(seasons, "area", "full").select(
        "area", F.coalesce(F.col("seasons.mark"), F.array().cast("array<binary>")).alias("marks"),
        F.coalesce(F.col("seasons.chars"), F.array().cast("array<bigint>")).alias("chars"),
    )
    # hex of a mark has a fixed width, so the joined text names the history
    named = F.unhex(F.md5(F.concat_ws("", F.transform("marks", lambda m: F.hex(m)))))
    histories = materialize(histories.withColumn("name", named), "histories")
    distinct = histories.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.min("area").alias("least"), F.any_value("marks").alias("marks"), F.any_value("chars").alias("chars")
    )
    distinct = materialize(distinct, "distinct_histories")
    ends = materialize(_ends(histories.select("name", "area"), distinct.filter("n > 1")), "ends")
    sortable = distinct.join(ends, "name", "left").select(
        "marks", "chars", "n", "least", F.coalesce("many", F.sha2(F.col("least").cast("string").cast("binary"), 256)).alias("ends")
    )
    held = distinct.agg(F.coalesce(F.sum(F.size("marks") + 1), F.lit(0))).first()[0]
    ranges = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // SEASONS_PER_RANGE))
    # the place holds the range in its upper bits
    ordered = materialize(
        sortable.repartitionByRange(ranges, "marks").sortWithinPartitions("marks").withColumn("at", F.monotonically_increasing_id()), "ordered"
    ).withColumn("part", F.shiftright("at", 33))
    edges = ordered.groupBy("part").agg(
        F.min("at").alias("from"), F.max("at").alias("to"), F.min_by("marks", "at").alias("first"), F.max_by("marks", "at").alias("last")
    )
    everywhere = Window.partitionBy(F.lit(1)).orderBy("part")  # one row per range
    edges = materialize(edges.select(
        "from", "to", F.lag("last").over(everywhere).alias("before"), F.lead("first").over(everywhere).alias("after")
    ), "edges")
    placed = (
        ordered.join(edges.select(F.col("from").alias("at"), "before"), "at", "left")
        .join(edges.select(F.col("to").alias("at"), "after"), "at", "left")
    )
    dealt = placed.repartition("part").sortWithinPartitions("at").select("part", "marks", "chars", "n", "least", "ends", "before", "after")
    nodes = materialize(arrow_step(dealt, _forests, _NODE), "nodes")

    merged = nodes.filter("key is not null").groupBy("key", "depth").agg(
        F.min("area").alias("area"), F.max("parent_key").alias("parent_key"), F.max("ends").alias("ends"),
        *[F.sum(c).alias(c) for c in ("n_areas", "n_children", "n_leaves", "all_chars", "new_chars")],
    )
    merged = materialize(merged, "open_nodes")
    both = nodes.filter("key is null").drop("key").unionByName(merged.drop("key").withColumn("parent_area", F.lit(None).cast("bigint")))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("area").alias("open_area"))
    return both.join(parents, "parent_key", "left").select(
        "area", "depth", F.coalesce("parent_area", "open_area").alias("parent_area"), "n_areas", "n_children", "n_leaves",
        (F.col("all_chars") - F.col("new_chars")).alias("saved_chars"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
    )


def prefix_tree(reports: DataFrame) -> DataFrame:
    """``history_tree`` of season reports (area, start_year, label, document)."""
    return history_tree(season_marks(reports), reports.select("area"))
