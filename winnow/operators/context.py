"""Code context of findings: enclosing function, imports, called functions, notes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions.text import numbered, text_lines
from winnow.operators import codeindex as C
from winnow.operators.codeindex import FILE
from winnow.schemas import CALLED_FUNCTION, CONTEXT, SAME_FILE, SAME_MODULE_IMPORT, STRINGS
from winnow.session import TEXTS, few, stage, tasks_for, unstage

FUNCTION = [*FILE, "function_start"]

# The notes a reviewer sees about what could not be extracted.
NOTE_SYNTAX = "File contains syntax errors; extraction is best-effort and may be incomplete."
NOTE_MODULE_LEVEL = (
    "Match is at module level (not inside any function or method); function context unavailable."
)


def enclosing_functions(spans: DataFrame, functions: DataFrame) -> DataFrame:
    """Innermost function that covers ``start_line``..``end_line`` of each distinct span.

    Functions nest, so every function around a span is the last one that starts at or before it,
    or one of that function's ancestors. One window per file finds the former, its ``chain`` holds
    the latter; spans and functions of a file are never paired up.
    """
    queries = spans.select(*FILE, "start_line", "end_line").distinct()
    events = queries.withColumn("chain", F.lit(None).cast(functions.schema["chain"].dataType)).unionByName(
        functions.select(*FILE, "start_line", F.lit(None).cast("int").alias("end_line"), "chain")
    )
    # At equal lines the header comes first: a function covers its own first line.
    order = Window.partitionBy(*FILE).orderBy("start_line", F.col("end_line").asc_nulls_first())
    # Chains take many times less room in a shuffle than in a task, so partitions go by the number of rows.
    events = events.repartition(tasks_for(spans.sparkSession, events.count()), *FILE)
    around = F.last("chain", ignorenulls=True).over(order)
    return (
        events.withColumn("_around", around)
        .filter("end_line IS NOT NULL")
        .withColumn(
            "_inner", F.try_element_at(F.filter("_around", lambda f: f["end_line"] >= F.col("end_line")), F.lit(-1))
        )
        .select(
            *FILE,
            "start_line",
            "end_line",
            F.col("_inner.start_line").alias("function_start"),
            F.col("_inner.end_line").alias("function_end"),
            F.col("_inner.name").alias("function_name"),
        )
    )


def module_candidates(path: Column, module: Column) -> dict[str, Column]:
    """The two files an imported module can be, as paths from the repository root.

    Relative modules climb one folder per leading dot after the first. Above the root the path
    starts with ``../``.
    """
    dots = F.length(F.regexp_extract(module, r"^\.*", 0))
    rest = F.regexp_replace(F.regexp_replace(module, r"^\.+", ""), r"\.", "/")
    folders = F.split(path, "/")
    depth = F.size(folders) - 1
    kept = F.array_join(F.slice(folders, 1, F.greatest(depth - (dots - 1), F.lit(0))), "/")
    climbed = F.repeat(F.lit("../"), F.greatest(dots - 1 - depth, F.lit(0)))
    base = F.concat(climbed, F.concat_ws("/", F.nullif(kept, F.lit("")), F.nullif(rest, F.lit(""))))
    folder = F.when(dots > 0, F.regexp_replace(base, r"/$", "")).otherwise(rest)
    # A folder named like `pkg.d` loses its suffix when `.py` is put on.
    as_file = F.when(folder == "", F.lit(None)).otherwise(
        F.concat(F.regexp_replace(folder, r"(?<=[^/])\.[^/.]+$", ""), F.lit(".py"))
    )
    as_package = F.concat(F.when(folder == "", F.lit("")).otherwise(F.concat(folder, F.lit("/"))), F.lit("__init__.py"))
    usable = module != ""
    return {"as_file": F.when(usable, as_file), "as_package": F.when(usable, as_package)}


def resolve_modules(modules: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``target_path`` to distinct ``repo_id, path, module``: ``m.py``, else ``m/__init__.py``."""
    # Plain scans on this side: adaptive execution can then split the importers of a hot module.
    catalog = files.select("repo_id", F.col("path").alias("_found"))
    candidates = module_candidates(F.col("path"), F.col("module"))
    out = modules
    for name, candidate in candidates.items():
        hit = catalog.select(F.col("repo_id").alias("_repo"), F.col("_found").alias(f"_{name}"))
        out = out.join(hit, (F.col("repo_id") == F.col("_repo")) & (candidate == F.col(f"_{name}")), "left").drop("_repo")
    return out.withColumn("target_path", F.coalesce("_as_file", "_as_package")).drop("_as_file", "_as_package")


def borrowed_files(modules: DataFrame, files: DataFrame) -> DataFrame:
    """Files of other repositories of the tree that relative imports reach, at the paths these give them.

    Repositories are folders side by side, so ``../other/m.py`` from one root is ``m.py`` of ``other``. Few
    imports do that; the files are found by them, not the other way round.
    """
    candidates = F.array(*module_candidates(F.col("path"), F.col("module")).values())
    asked = modules.select("repo_id", F.explode(candidates).alias("_as")).filter(F.col("_as").rlike(r"^\.\./[^/.][^/]*/")).distinct()
    outside = asked.select(
        F.col("repo_id").alias("_asker"),
        "_as",
        F.regexp_extract("_as", r"^\.\./([^/]+)/(.*)$", 1).alias("repo_id"),
        F.regexp_extract("_as", r"^\.\./([^/]+)/(.*)$", 2).alias("path"),
    )
    return files.join(outside, FILE).select(F.col("_asker").alias("repo_id"), F.col("_as").alias("path"), "length", "text")


def cut_out(places: DataFrame, lines: DataFrame, name: str, cut: Callable[[Column, Column], Column]) -> DataFrame:
    """``places`` (repo_id, path and more) with ``name``, what ``cut`` makes of the ``lines`` of their file and of the place.

    ``lines`` has one column beside the file. The places of a file meet its lines in one row, and leave it with their own part:
    rows that held a file's lines for every place in it would fill the disk wherever Spark keeps rows. Lines take many times
    less room as written than in a task, so Spark must not take them for small.
    """
    (text,) = [c for c in lines.columns if c not in FILE]
    fields = [c for c in places.columns if c not in FILE]
    together = places.groupBy(*FILE).agg(F.collect_list(F.struct(*fields)).alias("_places"))

    def part(place: Column) -> Column:
        return F.struct(*[place[c].alias(c) for c in fields], cut(F.col(text), place).alias(name))

    met = together.hint("merge").join(lines.hint("merge"), FILE)
    return met.select(*FILE, F.explode(F.transform("_places", part)).alias("_part")).select(*FILE, "_part.*")


def call_sites(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """Names each function calls: ``function_start, call_no, name``, deduped, in first-seen order."""

    def masked(text: Column, f: Column) -> Column:
        return F.array_join(C.source_between(text, f["function_start"], f["function_end"]), "\n")

    code = cut_out(functions.select(*FUNCTION, "function_end"), lines.select(*FILE, "masked_lines"), "_code", masked)
    return code.select(*FUNCTION, F.posexplode(C.call_names(F.col("_code"))).alias("call_no", "name"))


def resolve_calls(
    calls: DataFrame, same_file: DataFrame, imports: DataFrame, module_definitions: DataFrame
) -> DataFrame:
    """Where each called name is defined: in the same file, else one import away.

    ``same_file`` and ``module_definitions`` hold one row per (repo_id, path, name), ``imports``
    one per imported name with its ``target_path``; the joins never multiply calls. Unresolved
    calls keep NULL in ``def_path``.
    """
    local = same_file.select(*FILE, "name", F.struct("start_line", "end_line").alias("_local"))
    there = module_definitions.select(
        "repo_id",
        F.col("path").alias("target_path"),
        F.col("name").alias("target"),
        F.struct("start_line", "end_line").alias("_there"),
    )
    hop = imports.select(*FILE, "name", "target", "target_path").join(there, ["repo_id", "target_path", "target"])
    return (
        calls.join(local, [*FILE, "name"], "left")
        .join(hop.select(*FILE, "name", "target_path", "_there"), [*FILE, "name"], "left")
        .select(
            *FUNCTION,
            "call_no",
            "name",
            F.when(F.col("_local").isNotNull(), F.col("path")).otherwise(F.col("target_path")).alias("def_path"),
            F.coalesce("_local.start_line", "_there.start_line").alias("def_start"),
            F.coalesce("_local.end_line", "_there.end_line").alias("def_end"),
            F.when(F.col("_local").isNotNull(), F.lit(SAME_FILE))
            .when(F.col("_there").isNotNull(), F.lit(SAME_MODULE_IMPORT))
            .alias("resolution_method"),
        )
    )


def unresolved_calls(resolved: DataFrame) -> DataFrame:
    return resolved.filter("def_path IS NULL").select(*FUNCTION, "call_no", "name")


class CodeIndex:
    """Everything the contexts of a set of spans need, file by file.

    Only files that a span points into are indexed, and of the files they import only those that
    exist in the tree. ``spans`` holds ``repo_id, path, start_line, end_line``.
    """

    def __init__(
        self, spans: DataFrame, files: DataFrame, follow_alias: bool = False, max_file_bytes: int | None = None
    ):
        spans = spans.filter(F.col("path").endswith(".py"))
        wanted = few(spans.select(*FILE))
        self.lines = stage(C.file_lines(files.join(wanted, FILE, "left_semi"), max_file_bytes), TEXTS)
        self.logical = stage(C.logical_lines(self.lines))
        self.functions = stage(C.functions(C.blocks(self.logical)))
        statements = stage(C.import_statements(self.logical, self.lines))
        self.imports_text = C.imports_text(statements)
        self.spans = stage(enclosing_functions(spans, self.functions))
        self.needed = self.spans.filter("function_start IS NOT NULL").select(
            *FUNCTION, "function_end", "function_name"
        ).distinct()

        calls = stage(call_sites(self.needed, self.lines))
        imported = C.imports_map(statements, follow_alias)
        # Only names that are called can lead to another file.
        called = imported.join(calls.select(*FILE, "name").distinct(), [*FILE, "name"], "left_semi")
        modules = stage(called.select(*FILE, "module").distinct())
        borrowed = stage(borrowed_files(modules, files))
        if not borrowed.isEmpty():
            files = files.select(*FILE, "length", "text").unionByName(borrowed)
        modules = resolve_modules(modules, files)
        self.imports = stage(called.join(modules, [*FILE, "module"]))
        targets = self.imports.filter("target_path IS NOT NULL").select("repo_id", F.col("target_path").alias("path"))
        self.target_lines = stage(C.file_lines(files.join(few(targets), FILE, "left_semi"), max_file_bytes), TEXTS)
        target_functions = C.functions(C.blocks(C.logical_lines(self.target_lines)))
        elsewhere = stage(C.definitions(target_functions))
        self.calls = stage(resolve_calls(calls, C.definitions(self.functions), self.imports, elsewhere))

    def suspects(self) -> DataFrame:
        """Files that cannot be parsed as they stand."""
        return self.lines.filter("problem IS NOT NULL").select(*FILE)

    def called_functions(self) -> DataFrame:
        """Per function its resolved calls with their source, and the notes about the others.

        A definition's text is cut out once, however many functions call it.
        """
        found = self.calls.filter("def_path IS NOT NULL")
        definitions = found.select(
            "repo_id", F.col("def_path").alias("path"), "def_start", "def_end"
        ).distinct()
        lines = self.lines.select(*FILE, "raw_lines").unionByName(
            self.target_lines.join(self.lines.select(*FILE), FILE, "left_anti").select(*FILE, "raw_lines")
        )
        # Of most files nothing is shown here.
        lines = lines.join(few(definitions.select(*FILE)), FILE, "left_semi")
        shown = cut_out(definitions, lines, "source", lambda text, d: numbered(C.source_between(text, d["def_start"], d["def_end"]), d["def_start"]))
        texts = shown.select("repo_id", F.col("path").alias("def_path"), "def_start", "source")
        callee = F.when(
            F.col("def_path").isNotNull(),
            F.struct(
                "name",
                "source",
                F.col("def_path").alias("file_path"),
                F.col("def_start").alias("start_line"),
                "resolution_method",
            ),
        )
        note = F.when(
            F.col("def_path").isNull(),
            F.concat(F.lit("Definition of `"), F.col("name"), F.lit("()` not resolved.")),
        )
        # A function's calls are bounded by its length, so collecting them is.
        ordered = F.sort_array(F.collect_list(F.struct("call_no", callee.alias("callee"), note.alias("note"))))
        # Most calls are unresolved; they meet no text, so they stay out of the join.
        unresolved = self.calls.filter("def_path IS NULL").withColumn("source", F.lit(None).cast("string"))
        return (
            found.join(texts, ["repo_id", "def_path", "def_start"], "left")
            .unionByName(unresolved)
            .groupBy(*FUNCTION)
            .agg(ordered.alias("_calls"))
            .select(
                *FUNCTION,
                F.filter(F.transform("_calls", lambda c: c["callee"]), lambda c: c.isNotNull()).alias("called_functions"),
                F.filter(F.transform("_calls", lambda c: c["note"]), lambda n: n.isNotNull()).alias("call_notes"),
            )
        )

    def function_texts(self) -> DataFrame:
        """Per needed function its raw text."""

        def raw(text: Column, f: Column) -> Column:
            return F.array_join(C.source_between(text, f["function_start"], f["function_end"]), "\n")

        needed = self.needed.select(*FUNCTION, "function_end")
        return cut_out(needed, self.lines.select(*FILE, "raw_lines"), "function_text", raw).select(*FUNCTION, "function_text")

    def release(self) -> None:
        """Remove the lines of the files, when all that is read of them has been written."""
        unstage(self.lines, self.target_lines, self.logical)

    def leaving_repository(self) -> DataFrame:
        """Functions with a call defined in a file outside the repository, which fails the context."""
        return self.calls.filter(F.col("def_path").startswith("../")).select(*FUNCTION).distinct()


def build_contexts(
    findings: DataFrame, files: DataFrame, follow_alias: bool = False, max_file_bytes: int | None = None
) -> DataFrame:
    """Add ``context``, ``function_text`` and ``context_error`` to processable findings.

    Files of every size are indexed unless ``max_file_bytes`` sets a limit; findings in a file above
    it get a note instead, and calls into one stay unresolved.

    Findings are first reduced to distinct spans; all lookups work on spans, functions and names,
    and texts are attached to those. The findings themselves take part in a single left join, so
    they are shuffled once and each keeps exactly one row.
    """
    spans = findings.select("repo_id", F.col("file_path").alias("path"), "start_line", "end_line")
    index = CodeIndex(spans, files, follow_alias, max_file_bytes)

    # Texts are written here, so that the files' lines and their shuffles are gone before the findings are moved.
    texts = stage(index.function_texts(), TEXTS)
    per_function = stage(
        texts.join(index.called_functions(), FUNCTION, "left")
        .join(index.leaving_repository().withColumn("_leaves", F.lit(True)), FUNCTION, "left"),
        TEXTS,
    )
    suspects = stage(index.suspects())
    unstage(texts)
    index.release()
    known = (
        files.select(*FILE, "length")
        .join(spans.select(*FILE).distinct(), FILE, "left_semi")
        .join(suspects.withColumn("_suspect", F.lit(True)), FILE, "left")
        .join(index.imports_text, FILE, "left")
    )
    per_span = (
        index.spans.drop("function_end")
        .join(known, FILE, "left")
        .join(per_function, FUNCTION, "left")
        .withColumnRenamed("path", "file_path")
    )
    out = findings.join(per_span, ["repo_id", "file_path", "start_line", "end_line"], "left")
    too_large = F.lit(False) if max_file_bytes is None else F.col("length") > max_file_bytes
    readable = F.col("length").isNotNull() & ~too_large
    notes = F.concat(
        F.filter(
            F.array(
                F.when(F.col("length").isNull(), F.concat(F.lit("Source file not found: "), F.col("file_path"))),
                F.when(
                    too_large,
                    F.concat(
                        F.lit("File too large to parse ("),
                        F.col("length").cast("string"),
                        F.lit(" bytes); skipping AST-based extraction."),
                    ),
                ),
                F.when(readable & F.col("_suspect"), F.lit(NOTE_SYNTAX)),
                F.when(readable & F.col("function_start").isNull(), F.lit(NOTE_MODULE_LEVEL)),
            ),
            lambda note: note.isNotNull(),
        ),
        F.coalesce("call_notes", F.array().cast(STRINGS)),
    )
    # Numbers are put in front here: a function's text is moved once, without them.
    function_source = F.when(F.col("function_text").isNotNull(), numbered(F.split("function_text", "\n"), F.col("function_start")))
    context = F.struct(
        F.lit("python").alias("language"),
        numbered(text_lines(F.col("matched_code")), F.col("start_line")).alias("matched_code_with_lines"),
        F.col("imports"),
        F.col("function_name").alias("containing_function_name"),
        function_source.alias("containing_function_source"),
        F.col("function_start").alias("containing_function_start_line"),
        F.coalesce("called_functions", F.array().cast(f"array<{CALLED_FUNCTION.simpleString()}>")).alias("called_functions"),
        notes.alias("extraction_notes"),
    ).cast(CONTEXT)
    error = F.when(F.col("_leaves"), F.lit("ValueError"))
    return out.select(
        *findings.columns, context.alias("context"), "function_text", error.alias("context_error")
    )


def is_degraded(context: Column) -> Column:
    """Nothing to reason about: no function, no called function, no imports."""
    return (
        (F.coalesce(context["containing_function_source"], F.lit("")) == "")
        & (F.size(context["called_functions"]) == 0)
        & (F.coalesce(context["imports"], F.lit("")) == "")
    )
