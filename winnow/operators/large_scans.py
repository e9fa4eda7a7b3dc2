"""Scan documents that are larger than a task: a JSON text is cut at its commas and put together by element.

A piece is what stands between two commas. Whether it begins inside a string, and how deep in brackets, follows
from the pieces before it. Both are sums, so each chunk of a file adds up its own, for either way it may begin;
the few sums of the chunks are added up per file, and every piece learns where it stands without a task that
reads the whole document. The pieces of one result then meet, and only they are parsed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.operators import ingest as I
from winnow.session import TEXTS, stage, unstage

SCAN = ["scan_id", "repo_id"]
CHUNK = [*SCAN, "chunk"]

_STRING = r'"(?s:[^"\\]++|\\.)*+(?:"|\z)'
_REST_OF_STRING = r'^(?s:[^"\\]++|\\.)*+(?:"|\z)'
_KEY = r'^\s*+\{?\s*+"((?s:[^"\\]++|\\.)*+)"\s*+:\s*+'


class Scans(NamedTuple):
    """``documents``: scan_id, repo_id, doc_error, one row per file; ``results``: as :func:`ingest.raw_results` gives
    them; ``errors``: the loosely typed entries of ``errors``, with error_idx."""

    documents: DataFrame
    results: DataFrame
    errors: DataFrame


def assemble(pieces: DataFrame) -> Scans:
    """Results and errors of scans read by :func:`winnow.sources.readers.read_scan_pieces`.

    A file is unusable as a whole where its brackets or strings do not end, where anything follows its document, or
    where an entry of ``results`` or ``errors`` is not JSON; values of other keys are not looked into. Of
    a key that stands twice the last counts. No files, no rows.
    """
    measured = stage(_measured(pieces))
    placed = _placed(measured)
    unstage(measured)
    parts = stage(_parts(placed))
    unstage(placed)
    elements = stage(_elements(parts, pieces), TEXTS)
    documents = stage(_documents(pieces, elements))
    usable = documents.filter("doc_error IS NULL").select(*SCAN)
    entries = elements.filter("counts AND (NOT is_key OR entry != '')").select(*SCAN, "key", "idx", F.try_parse_json("entry").alias("value"))
    kept = entries.join(usable, SCAN, "left_semi")
    return Scans(
        documents,
        kept.filter("key = 'results'").select(*SCAN, F.col("idx").alias("result_idx"), F.col("value").alias("result")),
        kept.filter("key = 'errors'").select(*SCAN, F.col("idx").alias("error_idx"), F.col("value").alias("error")),
    )


def _measured(pieces: DataFrame) -> DataFrame:
    """Each piece with its brackets, read as if it began outside a string and as if inside one, and the key it may begin with.

    The texts stay where they were written: windows and sums take these numbers only.
    ``odd`` tells that strings begin or end an odd number of times in it. In valid JSON no bracket opens behind
    one that closes without a comma between them.
    """

    def skeleton(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(text, _STRING, ""), r"[^\[\]{}]++", "")

    def depth(brackets: Column) -> Column:
        return F.length(F.translate(brackets, "]}", "")) - F.length(F.translate(brackets, "[{", ""))

    read = pieces.withColumns(
        {
            "outside": skeleton(F.col("piece")),
            "inside": skeleton(F.regexp_replace("piece", _REST_OF_STRING, "")),
            "odd": F.length(F.regexp_replace("piece", r'(?s)[^"\\]++|\\.', "")) % 2,
            "named": F.regexp_extract("piece", _KEY, 1),
        }
    )
    return read.withColumns(
        {
            "deeper_outside": depth(F.col("outside")),
            "deeper_inside": depth(F.col("inside")),
            "bad_outside": F.col("outside").rlike(r"[\]}].*[\[{]"),
            "bad_inside": F.col("inside").rlike(r"[\]}].*[\[{]"),
        }
    ).drop("outside", "inside", "piece", "file_size")


def _before(order: Column | str, keys: list[str]):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _placed(measured: DataFrame) -> DataFrame:
    """Pieces with ``quoted`` (begins inside a string), ``depth`` before and ``after`` it, and ``bad``."""
    here = _before("at", CHUNK)
    local = measured.withColumn("turned", F.coalesce(F.sum("odd").over(here), F.lit(0)) % 2)
    # deeper by this piece where the chunk begins outside (0) or inside (1) a string
    ways = {0: ("deeper_outside", "deeper_inside"), 1: ("deeper_inside", "deeper_outside")}
    for begins, (even, odd) in ways.items():
        local = local.withColumn(f"deeper{begins}", F.when(F.col("turned") == 0, F.col(even)).otherwise(F.col(odd)))
    local = local.withColumns({f"local{b}": F.coalesce(F.sum(f"deeper{b}").over(here), F.lit(0)) for b in ways})
    # what pieces keep their place by among those of their chunk
    local = local.withColumn("place", F.row_number().over(Window.partitionBy(*CHUNK).orderBy("at")))
    local = stage(local.drop("deeper_outside", "deeper_inside"))

    chunks = local.groupBy(*CHUNK).agg(F.sum("odd").alias("odd"), *[F.sum(f"deeper{b}").alias(f"deeper{b}") for b in ways])
    earlier = _before("chunk", SCAN)
    chunks = chunks.withColumn("begins", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    deeper = F.when(F.col("begins") == 0, F.col("deeper0")).otherwise(F.col("deeper1"))
    chunks = chunks.withColumn("base", F.coalesce(F.sum(deeper).over(earlier), F.lit(0))).select(*CHUNK, "begins", "base")

    first = F.col("begins") == 0
    quoted = (F.col("begins") + F.col("turned")) % 2 == 1
    depth = F.col("base") + F.when(first, F.col("local0")).otherwise(F.col("local1"))
    return local.join(chunks, CHUNK).select(
        *CHUNK,
        "at",
        "place",
        "named",
        quoted.alias("quoted"),
        depth.alias("depth"),
        (depth + F.when(first, F.col("deeper0")).otherwise(F.col("deeper1"))).alias("after"),
        F.when(quoted, F.col("bad_inside")).otherwise(F.col("bad_outside")).alias("bad"),
        (F.col("odd") % 2 == 1).alias("odd"),
    )


def _parts(placed: DataFrame) -> DataFrame:
    """One row per chunk and entry or top-level key with pieces in it: where they begin, how many they are and what they tell.

    Marks are the pieces that begin a key's value or an entry. ``no`` counts those of a chunk so far, ``name`` is the
    last key of the chunk with its number.
    """
    top = ~F.col("quoted") & (F.col("depth") <= 1)
    marked = placed.withColumn("is_key", top).withColumn("mark", (top | (~F.col("quoted") & (F.col("depth") == 2))).cast("long"))
    so_far = Window.partitionBy(*CHUNK).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("no", F.sum("mark").over(so_far))
    name = F.when(F.col("is_key"), F.struct(F.col("named").alias("key"), F.col("no").alias("no")))
    marked = marked.withColumn("name", F.last(name, ignorenulls=True).over(so_far))
    return marked.groupBy(*CHUNK, "no", "name").agg(
        F.min("place").alias("place"),
        F.count("*").cast("int").alias("n"),
        F.max("is_key").alias("is_key"),
        F.min("depth").alias("depth"),
        F.max_by(F.struct("after", "quoted", "odd"), "at").alias("end"),
        F.max(F.col("bad") | (F.least("depth", "after") < 0)).alias("bad"),
        F.max("at").alias("at"),
    )


def _elements(parts: DataFrame, pieces: DataFrame) -> DataFrame:
    """One row per entry of a top-level list and per other top-level key: its text, and what is wrong with its pieces.

    Marks are counted within chunks, and the chunks' counts are summed per file, as is the last key of each. An element's
    pieces of one chunk are put together there, where a chunk's texts and the places of its elements meet in one row; then
    what several chunks hold of it.
    """
    chunks = parts.groupBy(*CHUNK).agg(F.max("no").alias("marks"), F.max_by("name", "at").alias("name"))
    earlier = _before("chunk", SCAN)
    chunks = chunks.withColumn("offset", F.coalesce(F.sum("marks").over(earlier), F.lit(0)))
    shifted = F.when(F.col("name").isNotNull(), F.struct(F.col("name.key"), (F.col("name.no") + F.col("offset")).alias("no")))
    chunks = chunks.withColumn("carried", F.last(shifted, ignorenulls=True).over(earlier)).select(*CHUNK, "marks", "offset", "carried")

    own = F.struct(F.col("name.key"), (F.col("name.no") + F.col("offset")).alias("no"))
    known = parts.join(chunks, CHUNK).withColumn("of", F.when(F.col("name").isNotNull(), own).otherwise(F.col("carried")))
    # a row per file and top-level key, found among the parts that begin one
    latest = known.filter("is_key").groupBy(*SCAN, F.col("of.key").alias("key")).agg(F.max("of.no").alias("last_no"))

    told = ["place", "n", "is_key", "depth", "end", "bad", "at"]
    element = [*SCAN, "no", "of"]
    known = known.withColumn("cut", (F.col("no") == 0) | (F.col("no") == F.col("marks")))
    known = known.withColumn("no", F.col("offset") + F.col("no"))
    ordered = F.sort_array(F.collect_list(F.struct("at", "piece")))
    texts = pieces.groupBy(*CHUNK).agg(ordered.alias("pieces")).select(*CHUNK, F.col("pieces.piece").alias("texts"))

    def with_text(part: Column) -> Column:
        # an entry's text is needed only of lists that are read, and of other keys the piece that begins them
        wanted = F.coalesce(part["of"]["key"].isin("results", "errors"), F.lit(False))
        n = F.when(wanted, part["n"]).when(part["is_key"], 1).otherwise(0)
        text = F.array_join(F.slice("texts", part["place"], n), ",")
        return F.struct(*[part[c].alias(c) for c in ("no", "of", *told)], text.alias("text"))

    def put_together(these: DataFrame) -> DataFrame:
        places = these.select(*CHUNK, F.struct("no", "of", *told).alias("part")).groupBy(*CHUNK).agg(F.collect_list("part").alias("parts"))
        # Texts take many times less room as written than in a task, so Spark must not take them for small.
        met = places.hint("merge").join(texts.hint("merge"), CHUNK)
        return met.select(*CHUNK, F.explode(F.transform("parts", with_text)).alias("p")).select(*CHUNK, "p.*")

    # only the first and the last element of a chunk can have pieces in another one: the others' texts are not moved again
    ordered = F.sort_array(F.collect_list(F.struct("chunk", "text")))
    over_chunks = put_together(known.filter("cut")).groupBy(*element).agg(
        F.array_join(F.transform(ordered, lambda p: p["text"]), ",").alias("text"),
        F.max("is_key").alias("is_key"),
        F.min("depth").alias("depth"),
        F.max_by("end", F.struct("chunk", "at")).alias("end"),
        F.max("bad").alias("bad"),
        F.max(F.struct("chunk", "at")).alias("last"),
    )
    within = put_together(known.filter("NOT cut")).withColumn("last", F.struct("chunk", "at"))
    grouped = within.select(*over_chunks.columns).unionByName(over_chunks).withColumns({"key_no": F.col("of.no"), "key": F.col("of.key")})
    # behind the last entry stand the list's bracket and, at the end, the document's
    body = F.when(F.col("is_key"), F.regexp_replace("text", _KEY, "")).otherwise(F.col("text"))
    listed = body.startswith("[") | ~F.col("is_key")
    body = F.when(F.col("is_key"), F.regexp_replace(body, r"^\[", "")).otherwise(body)
    body = F.when(F.col("end.after") == 0, F.regexp_replace(body, r"\s*+\}\s*+\z", "")).otherwise(body)
    body = F.when(F.col("end.after") <= 1, F.regexp_replace(body, r"\]\s*+\z", "")).otherwise(body)
    return grouped.join(latest, [*SCAN, "key"]).select(
        *SCAN,
        "key",
        "key_no",
        (F.col("no") - F.col("key_no")).cast("int").alias("idx"),
        "is_key",
        F.trim(F.regexp_replace(body, r"^\s++|\s++\z", "")).alias("entry"),
        listed.alias("listed"),
        F.when(F.col("is_key"), F.col("text").rlike(_KEY) & (F.col("text").rlike(r"^\s*+\{") == (F.col("depth") == 0)))
        .otherwise(True)
        .alias("formed"),
        (F.col("key_no") == F.col("last_no")).alias("counts"),
        "depth",
        "end",
        "bad",
        "last",
    ).filter("counts OR is_key")


def _documents(pieces: DataFrame, elements: DataFrame) -> DataFrame:
    """What is wrong with each file, if anything."""
    read = pieces.groupBy(*SCAN).agg(
        F.sum(F.octet_length("piece").cast("long") + 1).alias("bytes"),
        F.max("file_size").alias("file_size"),
        F.min_by("piece", F.struct("chunk", "at")).alias("first"),
    )
    is_entry = F.col("key").isin("results", "errors") & F.col("counts") & F.col("listed") & (F.col("entry") != "")
    lost = F.col("key").isin("results", "errors") & ~F.col("is_key") & (F.col("entry") == "")
    broken = F.col("bad") | ~F.col("formed") | lost | (is_entry & F.try_parse_json("entry").isNull())
    told = elements.groupBy(*SCAN).agg(
        F.max(broken).alias("broken"),
        F.max_by("end", "last").alias("end"),
        F.count_if(F.col("is_key") & (F.col("depth") == 0)).alias("begun"),
        F.count_if(F.col("is_key") & (F.col("key") == "results")).alias("has_results"),
        F.max(F.col("is_key") & F.col("counts") & (F.col("key") == "results") & F.col("listed")).alias("listed"),
    )
    ended = (F.col("end.after") == 0) & (F.col("end.quoted") == F.col("end.odd"))
    why = (
        F.when(~F.col("first").rlike(r"^\s*+[\[{\"\-0-9tfn]"), "not valid JSON")
        .when(~F.col("first").rlike(r"^\s*+\{"), "not a JSON object")
        .when(~ended | (F.col("bytes") - 1 != F.col("file_size")), "not valid JSON")
        .when(F.col("begun") > 1, "not valid JSON")
        .when(F.col("first").rlike(r"^\s*+\{\s*+\}\s*+\z"), "no top-level results")
        .when(F.col("broken"), "not valid JSON")
        .when(F.col("has_results") == 0, "no top-level results")
        .when(~F.col("listed"), "results is not a list")
    )
    return read.join(told, SCAN, "left").select(*SCAN, why.alias("doc_error"))


def scan_errors(scans: Scans) -> DataFrame:
    """As :func:`ingest.scan_errors`."""
    return I.describe_errors(scans.errors)
