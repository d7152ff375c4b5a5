"""GeoJSON of any size, a file read by as many tasks as it has splits.

Spark's text source cuts a file at closing braces, so that a split begins where a JSON object ended, but knows neither
whether that was within a string nor how deep.  A first pass sums up each split for both cases (strings begun or not):
how depth changes, how low it falls, how many objects open at each depth.  Running sums over a file's splits then give
each split its true state, and a second pass cuts out the features.  One that crosses splits is put together from its
pieces by a group of its own; no more than a feature, or a split's summary, is ever held whole.  Features are parsed
by Spark's JSON functions.

A file whose root is a single feature is read alike, one level up.  Objects of other arrays are left out by their type.
The splits must be the same in both passes; where they are not (files or cores changed in between) the read fails.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEATURE = "type string, id string, geometry struct<type string, coordinates string>, properties map<string,string>"
#: Depth of a collection's features: within the root and its array.
IN_COLLECTION, AS_ROOT = 3, 1
_CRS = re.compile(rb'"crs"\s*:\s*\{[^{}]*"properties"\s*:\s*\{[^{}]*"name"\s*:\s*"([^"]*)"')
_EDGE = 400
#: Bytes that are looked at one after the other before a place.
_STEPS = 64
_SUMMARY = "file string, start bigint, size bigint, parity int, delta array<bigint>, low array<bigint>, opened array<map<bigint,bigint>>, many boolean, crs string, head string, tail string"


def records(spark: SparkSession, path: str) -> DataFrame:
    """Text between closing braces, in order within a split."""
    at = F.col("_metadata")
    return spark.read.option("lineSep", "}").text(path).select(F.col("value").cast("binary").alias("value"), at.file_path.alias("file"), at.file_block_start.alias("start"), at.file_block_length.alias("size"))


def last_other(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place the last one before it that is not of the mask, or -1."""
    before = at - 1
    for _ in range(_STEPS):
        on = mask[before] & (before >= 0)
        if not on.any():
            return before
        before = before - on
    # A long run of them: all places at once.
    other = np.maximum.accumulate(np.where(mask, -1, np.arange(len(mask))))
    return np.where(at > 0, other[at - 1], -1)


def quotes(b: np.ndarray) -> np.ndarray:
    """Places of quotes that begin or end strings."""
    at = np.flatnonzero(b == 34)
    slashes = b == 92
    return at[(at - 1 - last_other(slashes, at)) % 2 == 0] if slashes.any() else at


def brackets(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places, +1 or -1, parity of the quotes before) of all brackets, and the parity of all quotes."""
    b = np.frombuffer(data, np.uint8)
    q = quotes(b)
    at = np.flatnonzero((b == 123) | (b == 91) | (b == 125) | (b == 93))
    return at, np.where((b[at] == 123) | (b[at] == 91), 1, -1), np.searchsorted(q, at) & 1, len(q) & 1


def elements(text: bytes, at: np.ndarray) -> np.ndarray:
    """Which of the braces there begin no member's value: the last byte before, but for white space, is no colon."""
    b = np.frombuffer(text, np.uint8)
    before = last_other((b == 32) | ((b >= 9) & (b <= 13)), at)
    return (before < 0) | (b[before] != 58)


def by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[bytes, dict]]]]:
    """For each split of a task its text, a batch at a time, with the first row of each."""

    def rows() -> Iterator[tuple[tuple, bytes, dict]]:
        for batch in batches:
            if not len(batch):
                continue
            value = batch.column("value").to_numpy(zero_copy_only=False).tolist()
            other = np.zeros(len(value) - 1, bool)
            for c in ("file", "start", "size"):
                column = batch.column(c)
                other |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(other) + 1).tolist(), len(value)]
            for a, b in zip(cuts, cuts[1:]):
                row = {c: batch.column(c)[a].as_py() for c in batch.schema.names if c != "value"}
                yield (row["file"], row["start"], row["size"]), b"}".join(value[a:b]) + b"}", row

    for key, some in groupby(rows(), lambda r: r[0]):
        yield key, ((text, row) for _, text, row in some)


def summaries(pieces: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start, size), texts in by_split(batches):
            parity, depth, low, opened = 0, [0, 0], [0, 0], [Counter(), Counter()]
            many, crs, head, tail = False, None, b"", b""
            for text, _ in texts:
                at, change, before, odd = brackets(text)
                objects = np.frombuffer(text, np.uint8)[at] == 123
                objects[objects] = elements(text, at[objects])
                for s in (0, 1):
                    mine = (before ^ parity) == s  # outside of strings, had the split begun with s of them
                    levels = depth[s] + np.cumsum(change[mine])
                    if len(levels):
                        depth[s], low[s] = int(levels[-1]), min(low[s], int(levels.min()))
                        opened[s].update(dict(zip(*(x.tolist() for x in np.unique(levels[objects[mine]], return_counts=True)))))
                parity ^= odd
                many |= b'"FeatureCollection"' in text
                if crs is None and (m := _CRS.search(text)):
                    crs = m[1].decode("utf-8", "replace")
                head, tail = (head + text[:_EDGE])[:_EDGE], (tail + text)[-_EDGE:]
            row = {"file": file, "start": start, "size": size, "parity": parity, "delta": depth, "low": low, "opened": [list(c.items()) for c in opened], "many": many, "crs": crs, "head": head.decode("utf-8", "replace"), "tail": tail.decode("utf-8", "replace")}
            map_ = pa.map_(pa.int64(), pa.int64())
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(map_), pa.bool_(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds)], names=list(row))

    return pieces.mapInArrow(run, _SUMMARY)


def states(summary: DataFrame) -> DataFrame:
    """A row for each split: whether it begins in a string, its depth, how many objects come before, the split where
    the object began that is open at its start, and whether one is open at its start or its end."""
    file = Window.partitionBy("file")
    before = file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    lagged = lambda c: F.lag(c).over(file.orderBy("start"))
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    crossing = F.regexp_extract(F.concat(F.coalesce(lagged("tail"), F.lit("")), "head"), _CRS.pattern.decode(), 1)
    out = summary.withColumns({"level": F.when(F.max("many").over(file), IN_COLLECTION).otherwise(AS_ROOT), "inside": (so_far("parity") % 2).cast("int"), "named": F.coalesce("crs", F.nullif(crossing, F.lit("")))})
    mine = lambda c: F.element_at(c, F.col("inside") + 1)
    out = out.withColumns({"delta": mine("delta"), "low": mine("low"), "opened": mine("opened"), "crs": F.first_value("named", ignoreNulls=True).over(file.orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    out = out.withColumn("depth", so_far("delta"))
    # Objects of the level that begin here; the text of one that is open at the end began at the last split that was not
    # inside one throughout.
    out = out.withColumns({"opened": F.coalesce(F.try_element_at("opened", F.col("level") - F.col("depth")), F.lit(0)), "fresh": F.when((F.col("depth") < F.col("level")) | (F.col("depth") + F.col("low") < F.col("level")), F.col("start"))})
    crosses = (F.col("depth") >= F.col("level")) | (F.col("depth") + F.col("delta") >= F.col("level"))
    return out.select("file", "start", "size", "inside", "depth", "level", so_far("opened").alias("ahead"), F.last_value("fresh", ignoreNulls=True).over(before).alias("owner"), "crs", crosses.alias("crosses"))


_PIECES = "file string, crs string, owner bigint, start bigint, number bigint, whole boolean, text binary"


def cut(pieces: DataFrame) -> DataFrame:
    """Objects of the level: whole ones, and pieces of those that cross splits, with the split where they begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start, _), texts in by_split(batches):
            depth = None
            for text, row in texts:
                if depth is None:
                    level, depth, inside, number, crs = row["level"], row["depth"], row["inside"], row["ahead"], row["crs"]
                    owner = row["owner"] if depth >= level else None
                    held = [] if depth >= level else None
                    began = -1
                out = []
                at, change, parity, odd = brackets(text)
                mine = (parity ^ inside) == 0
                at, change = at[mine], change[mine]
                levels = depth + np.cumsum(change)
                curly = np.frombuffer(text, np.uint8)[at]
                opens, closes = at[(curly == 123) & (levels == level)], at[(curly == 125) & (levels == level - 1)]
                if held is not None:
                    end = int(closes[0]) + 1 if len(closes) else len(text)
                    held.append(text[:end])
                    if len(closes):
                        out.append((file, crs, start if owner is None else owner, start, began, owner is None, b"".join(held)))
                        closes, held, owner = closes[1:], None, None
                element = elements(text, opens).tolist()
                own = [text[a : b + 1] for a, b, ok in zip(opens.tolist(), closes.tolist(), element) if ok]
                out.extend((file, crs, start, start, number + k, True, t) for k, t in enumerate(own))
                number += len(own)
                if len(opens) > len(closes):
                    # A member's value goes on as well, and is left out when it is read.
                    held, owner, began = [text[int(opens[-1]) :]], None, number if element[-1] else -1
                    number += element[-1]
                depth, inside = int(levels[-1]) if len(levels) else depth, inside ^ odd
                if out:
                    yield batch_of(out)
            if held is not None:  # it goes on in the next split; what began earlier has no number here
                yield batch_of([(file, crs, start if owner is None else owner, start, began, False, b"".join(held))])

    return pieces.mapInArrow(run, _PIECES)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["file", "crs", "owner", "start", "number", "whole", "text"])


def shape(geometry: Column) -> Column:
    """The brackets of a well-known text for a geometry's coordinates, which are JSON text; white space means nothing there."""
    number = r"([-+.\deE]+)"
    pairs = F.regexp_replace(F.regexp_replace(geometry.coordinates, r"\s+", ""), r"\[" + number + "," + number + r"(?:,[^\[\]]*)?\]", "$1 $2")
    return F.replace(F.translate(pairs, "[]", "()"), F.lit(","), F.lit(", "))


def wkt(kind: Column, body: Column) -> Column:
    """Well-known text of a kind and its brackets."""
    return F.when(F.length(body) > 2, F.concat(kind, F.lit(" "), F.when(kind == "POINT", F.concat(F.lit("("), body, F.lit(")"))).otherwise(body))).when(body.isNotNull(), F.concat(kind, F.lit(" EMPTY")))


def objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, crs, text) of every feature; number: its place in the file."""
    pieces = records(spark, path)
    # A row of a few numbers for each split: for 100 TB in splits of 128 MB some 60 MB.
    known = states(summaries(pieces))
    stated = pieces.join(F.broadcast(known), ["file", "start", "size"], "left")
    sure = stated.withColumn("level", F.coalesce("level", F.raise_error(F.lit("the splits of a file have changed between two reads")).cast("int")))
    whole = cut(sure).where("whole").select("file", "number", "crs", "text")
    # Only splits in which an object begins or goes on that another one ends are cut a second time.
    joined = cut(sure.where("crosses")).where("not whole").groupBy("file", "owner").agg(F.max("number").alias("number"), F.first("crs", True).alias("crs"), F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"))
    parts = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x.text))
    return whole.unionByName(joined.select("file", "number", "crs", parts.alias("text")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, id, kind, wkt, properties, crs) of every feature; crs is the collection's name, or null."""
    feature = F.from_json(F.col("text").cast("string"), FEATURE, {"mode": "FAILFAST"})
    # A text is parsed once: the test of the type is not pushed through what follows.
    rows = objects(spark, path).select("file", "number", "crs", F.explode(F.array(feature)).alias("feature")).where("feature.type = 'Feature'")
    geometry = F.col("feature.geometry")
    # Made before the text, which has it in several places.
    rows = rows.withColumns({"kind": F.upper(geometry.type), "body": shape(geometry)})
    held = F.coalesce("feature.properties", F.create_map().cast("map<string,string>"))
    # Numbers that are none come with quotes, other than texts.
    properties = F.transform_values(held, lambda _, v: F.when(~v.isin('"NaN"', '"Infinity"', '"-Infinity"'), v))
    return rows.select("file", "number", F.col("feature.id").alias("id"), "kind", wkt(F.col("kind"), F.col("body")).alias("wkt"), properties.alias("properties"), "crs")
