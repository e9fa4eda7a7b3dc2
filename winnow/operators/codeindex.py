"""Symbol tables of source files, built from lines.

A file is read once, however many findings point into it. Strings and comments are masked with one
regular expression over the file's text; everything else is windows over its lines, keyed by
(repo_id, path) or a longer key that starts with it. A file is one row before it is lines, so a window
holds no more than a row does.

Extents follow indentation; the result is best effort where a file does not parse.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions.text import let
from winnow.session import few, tasks_for

FILE = ["repo_id", "path"]

IDENTIFIER = r"[\p{L}_][\p{L}\p{N}_]*"
NOT_AFTER_WORD = r"(?<![\p{L}\p{N}_])"
NOT_BEFORE_WORD = r"(?![\p{L}\p{N}_])"

# Possessive groups keep the matcher from recursing, however long a string literal is.
_PREFIX = r"(?i:rb|br|rf|fr|rt|tr|r|b|u|f|t)"


def _strings(triple: str, single: str) -> str:
    """String literals of all four quotes, with what may follow the contents."""
    return "|".join(
        [
            rf'"""(?:[^"\\]++|\\.|"(?!""))*+(?:"""{triple})',
            rf"'''(?:[^'\\]++|\\.|'(?!''))*+(?:'''{triple})",
            rf'"(?:[^"\\\n]++|\\.)*+(?:"{single})',
            rf"'(?:[^'\\\n]++|\\.)*+(?:'{single})",
        ]
    )


_STRINGS = _strings(r"|\z", r"|(?=\n)|\z")
_STRING = rf"(?:{NOT_AFTER_WORD}{_PREFIX})?+(?:{_STRINGS})"
_COMMENT = r"#[^\n]*+"
_CODE = rf"(?:[^'\"#\p{{L}}\p{{N}}_]++|(?!{_PREFIX}['\"])[\p{{L}}\p{{N}}_]++)++"
_CLOSED = rf"(?s)^{_PREFIX}?+(?:{_strings('', '')})\z"
PIECES = rf"(?s)(?:{_STRING})|{_COMMENT}|(?:{_CODE})|."

# Every character of a string becomes QUOTED, and a line that ends inside one gets OPEN behind it; a string
# that nothing closes ends with BROKEN.
QUOTED = '"'
OPEN = "\x01"
BROKEN = "\x02"

HEADER = rf"^[ \t\f]*(?:async[ \t]+)?(def|class)[ \t]+({IDENTIFIER})"
# Words, numbers, strings, brackets, dots, line ends, and runs of anything else; a joined line is one.
TOKENS = (
    rf"(?:[ \t\f]++|\\\r?\n)*+({IDENTIFIER}+|\p{{N}}[\p{{L}}\p{{N}}_]*+(?:\.\p{{N}}[\p{{L}}\p{{N}}_]*+)?+|(?:{QUOTED}++|{OPEN}\n)++|[()\[\]{{}}.\n]"
    rf"|[^\p{{L}}\p{{N}}_{QUOTED}{OPEN}()\[\]{{}}.\s\\]++|\S)"
)
# What the block structure hangs on: line starts with what they tell, brackets, colons and lambdas.
_OPENERS = "def|class|if|elif|else|for|while|with|try|except|finally"
LAYOUT = (
    rf"(?::[ \t\f]*+|(?<![{OPEN}\\]))\n[ \t\f]*+(?:(?:async[ \t]++)?(?:{_OPENERS}){NOT_BEFORE_WORD})?+"
    rf"|[()\[\]{{}}]|:=|:|{NOT_AFTER_WORD}lambda{NOT_BEFORE_WORD}"
)
IMPORT = r"^(?:import|from)(?![\p{L}\p{N}_])"

# The language's keywords, which may stand before a bracket without being a call.
KEYWORDS = """
False None True and as assert async await break class continue def del elif else except finally for
from global if import in is lambda nonlocal not or pass raise return try while with yield
""".split()

# Names that are never looked up because the reviewer knows what they do.
KNOWN_BUILTINS = [
    "len",
    "range",
    "open",
    "print",
    "int",
    "str",
    "list",
    "dict",
    "set",
    "tuple",
    "bool",
    "float",
    "bytes",
    "type",
    "isinstance",
    "issubclass",
    "hasattr",
    "getattr",
    "setattr",
    "delattr",
    "callable",
    "iter",
    "next",
    "enumerate",
    "zip",
    "map",
    "filter",
    "sorted",
    "reversed",
    "any",
    "all",
    "sum",
    "min",
    "max",
    "abs",
    "round",
    "divmod",
    "pow",
    "repr",
    "hash",
    "id",
    "vars",
    "dir",
    "format",
    "input",
    "exec",
    "eval",
    "compile",
    "globals",
    "locals",
    "super",
    "object",
    "Exception",
    "ValueError",
    "TypeError",
    "KeyError",
    "IndexError",
    "AttributeError",
    "RuntimeError",
    "FileNotFoundError",
    "OSError",
    "IOError",
    "StopIteration",
]


def mask_code(text: Column) -> Column:
    """The text without comments and with string contents blotted out, line for line.

    Replacement fields of f-strings stay, as they hold code.
    """

    def blot(piece: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(piece, r"[^\n]", QUOTED), r"\n", OPEN + "\n")

    def broken(piece: Column) -> Column:
        return F.when(piece.rlike(_CLOSED), "").otherwise(BROKEN)

    def blot_fields(piece: Column) -> Column:
        parts = F.regexp_extract_all(
            F.regexp_replace(piece, r"\{\{|\}\}", QUOTED * 2), F.lit(r"(?s)\{[^{}\n]++\}|[^{]++|\{"), F.lit(0)
        )
        inner = r"'[^']*+'|\"[^\"]*+\""
        return F.array_join(
            F.transform(
                parts,
                lambda part: F.when(part.rlike(r"^\{.+\}$"), F.regexp_replace(part, inner, QUOTED)).otherwise(blot(part)),
            ),
            "",
        )

    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    masked = F.transform(
        pieces,
        lambda piece: F.when(piece.startswith("#"), F.lit(""))
        .when(piece.rlike(r"^(?i:f|t|rf|fr|rt|tr)['\"]"), F.concat(blot_fields(piece), broken(piece)))
        .when(piece.rlike(rf"^{_PREFIX}?['\"]"), F.concat(blot(piece), broken(piece)))
        .otherwise(piece),
    )
    return F.array_join(masked, "")


def file_lines(files: DataFrame, max_file_bytes: int | None = None) -> DataFrame:
    """Per file the raw and the masked lines as arrays of equal length, and its first syntax ``problem`` if it has one.

    Files above the limit stay out.
    """
    readable = files.filter(F.col("text").isNotNull())
    if max_file_bytes is not None:
        readable = readable.filter(F.col("length") <= max_file_bytes)
    # The masked text is a column of its own: it is read more than once, and a plan without the problem does not look for it.
    read = readable.select(*FILE, _split_lines(F.col("text")).alias("raw_lines"), mask_code(F.col("text")).alias("_masked"))
    return read.select(
        *FILE,
        "raw_lines",
        _split_lines(F.replace("_masked", F.lit(BROKEN), F.lit(""))).alias("masked_lines"),
        syntax_problem(F.col("_masked")).alias("problem"),
    )


def _split_lines(text: Column) -> Column:
    """Lines that end with ``\\n`` or ``\\r\\n``; most texts have the former only, which takes no pattern."""
    return F.when(F.contains(text, F.lit("\r")), F.split(text, "\r?\n")).otherwise(F.split(text, "\n"))


def syntax_problem(masked: Column) -> Column:
    """What keeps a masked file from being parsed, or null: the first of the problems that a line-wise reading can tell.

    ``bracket``: one that is not opened or closed · ``colon``: a block's header without one · ``block``: a header
    without an indented line after it · ``indent``: a line further in than it may be · ``dedent``: one that goes
    back to no open block · ``string``: one that is not closed.
    """
    # Lines without code go; a line at the margin behind the last one closes what is open.
    code = F.regexp_replace(F.translate(masked, "\r" + BROKEN, ""), r"\n[ \t\f]*+(?=\n|\z)", "")
    tokens = F.regexp_extract_all(F.concat(F.lit("\n"), code, F.lit("\nend")), F.lit(LAYOUT), F.lit(0))
    return F.coalesce(_layout_problem()(tokens), F.when(masked.contains(BROKEN), "string"))


def _layout_problem() -> Callable[[Column], Column]:
    """The first problem of a file's layout tokens.

    A loop over the tokens of one file, as a lambda of ``F.aggregate`` is interpreted anew for every token. A function inside
    this one reaches the workers by value, so they need no package.
    """

    def problem(tokens: list[str] | None) -> str | None:
        # ``header`` is set while a block's header waits for its colon
        brackets, indents, header, lambdas = [], [0], False, 0
        for token in tokens or ():
            if "\n" in token:
                defines = token.endswith(("def", "class"))
                # a definition cannot stand inside brackets: they were left open above
                if brackets:
                    if defines:
                        return "bracket"
                    continue
                begun = token[token.index("\n") + 1 :]
                lead = begun[: len(begun) - len(begun.lstrip(" \t\f"))]
                indent = len(lead[lead.rfind("\f") + 1 :].replace("\t", " " * 8))
                # a line that ends with a colon opens a block, also after a word that is no keyword everywhere (match, case)
                opens = token[0] == ":"
                if header and not opens:
                    return "colon"
                if opens and indent <= indents[-1]:
                    return "block"
                if not opens and indent > indents[-1]:
                    return "indent"
                if opens:
                    indents.append(indent)
                else:
                    while indents[-1] > indent:
                        indents.pop()
                    if indents[-1] != indent:
                        return "dedent"
                header, lambdas = "a" <= token[-1] <= "z", 0
            elif token in "([{":
                brackets.append(token)
            elif token in ")]}":
                if not brackets or brackets.pop() + token not in ("()", "[]", "{}"):
                    return "bracket"
            elif not brackets:
                if token == "lambda":
                    lambdas += 1
                elif token == ":":
                    header = header and lambdas > 0
                    lambdas = max(lambdas - 1, 0)
        return "bracket" if brackets else None

    return F.udf(problem, "string", useArrow=True)


def logical_lines(lines: DataFrame) -> DataFrame:
    """One row per logical line that holds code, with what the block structure needs of it.

    ``ln`` first physical line · ``code`` its masked text · ``indent`` (a tab counts 8) ·
    ``prev_code_ln`` last physical line with code before it · ``last_code_ln`` the same for the
    whole file · ``kind``/``name`` for ``def`` and ``class`` headers.
    """
    # Whole files are shuffled, once; the windows over their lines then stay in place. Masked lines take many times less
    # room in a shuffle than in a task, so partitions go by the number of lines.
    total = lines.agg(F.sum(F.size("raw_lines").cast("long"))).first()[0] or 0
    physical = lines.select(*FILE, "masked_lines").repartition(tasks_for(lines.sparkSession, total), *FILE).select(
        *FILE, F.posexplode("masked_lines").alias("pos", "line")
    )
    by_file = Window.partitionBy(*FILE)
    in_order = by_file.orderBy("ln")
    before = Window.unboundedPreceding, -1
    marked = physical.select(
        *FILE,
        (F.col("pos") + 1).alias("ln"),
        F.rtrim(F.translate("line", OPEN, "")).alias("code"),
        F.col("line").endswith(OPEN).alias("_open"),
        # A def or class keyword cannot stand inside brackets: brackets left open above it are an
        # error of that file, and counting starts afresh.
        F.col("line").rlike(HEADER).cast("int").alias("_header"),
        (F.length(F.translate("line", ")]}", "")) - F.length(F.translate("line", "([{", ""))).alias("_brackets"),
    )
    linked = (
        marked.withColumn("_in_string", F.coalesce(F.lag("_open").over(in_order), F.lit(False)))
        .withColumn("_joined", F.coalesce(F.lag(F.col("code").endswith("\\")).over(in_order), F.lit(False)))
        .withColumn("_section", F.sum("_header").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_is_code", F.length("code") > 0)
        .withColumn("_code_ln", F.when(F.col("_is_code") | F.col("_in_string"), F.col("ln")))
        .withColumn("prev_code_ln", F.max("_code_ln").over(in_order.rowsBetween(*before)))
    )
    in_section = Window.partitionBy(*FILE, "_section").orderBy("ln").rowsBetween(*before)
    code = (
        linked.withColumn("_depth", F.coalesce(F.sum("_brackets").over(in_section), F.lit(0)))
        .withColumn("last_code_ln", F.max("_code_ln").over(by_file))
        .filter(F.col("_is_code") & ~F.col("_in_string") & ~F.col("_joined") & (F.col("_depth") <= 0))
    )
    lead = F.regexp_extract("code", r"^[ \t\f]*", 0)
    indent = F.length(F.regexp_replace(F.regexp_replace(lead, r".*\f", ""), "\t", " " * 8))
    return code.select(
        *FILE,
        "ln",
        "code",
        indent.alias("indent"),
        "prev_code_ln",
        "last_code_ln",
        F.nullif(F.regexp_extract("code", HEADER, 1), F.lit("")).alias("kind"),
        F.nullif(F.regexp_extract("code", HEADER, 2), F.lit("")).alias("name"),
    )


def blocks(logical: DataFrame) -> DataFrame:
    """Functions and classes: ``kind, name, start_line, end_line, indent, chain, scope``.

    A logical line with a smaller indent than the line before closes the blocks in between, one
    close event per indent level at which the file has headers. A block ends at the next close event of its own level, and its
    ancestors are the latest still open headers of the lower levels, so both are a running window
    per level instead of a join of headers with lines.

    ``chain`` lists the enclosing functions from the outside in, the function itself included.
    ``scope`` is ``top`` for a function of the module, ``method`` for one of a top-level class,
    else ``inner``.
    """
    in_order = Window.partitionBy(*FILE).orderBy("ln")
    is_header = F.col("kind").isNotNull()
    above_indent = F.lag("indent").over(in_order)
    above_header = F.lag(is_header).over(in_order)
    stepped = (
        logical.withColumn("_body_indent", F.lead("indent").over(in_order))
        .withColumn("_top", F.when(above_header, above_indent).otherwise(above_indent - 1))
        .withColumn("levels", F.collect_set(F.when(is_header, F.col("indent"))).over(Window.partitionBy(*FILE)))
        .withColumn("_closes", F.filter("levels", lambda level: level.between(F.col("indent"), F.col("_top"))))
    )
    closing = F.transform("_closes", lambda level: F.struct(level.alias("level"), F.lit(0).alias("opens")))
    opening = F.when(is_header, F.array(F.struct(F.col("indent").alias("level"), F.lit(1).alias("opens"))))
    events = stepped.withColumn(
        "event", F.explode(F.concat(closing, F.coalesce(opening, F.array().cast("array<struct<level:int,opens:int>>"))))
    ).withColumn("level", F.col("event.level"))
    later = (
        Window.partitionBy(*FILE, "level")
        .orderBy(F.col("ln").desc(), F.col("event.opens").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ended = (
        events.withColumn(
            "_end", F.last(F.when(F.col("event.opens") == 0, F.col("prev_code_ln")), ignorenulls=True).over(later)
        )
        .filter("event.opens = 1")
        .select(
            *FILE,
            "kind",
            "name",
            F.col("ln").alias("start_line"),
            F.coalesce("_end", "last_code_ln").alias("end_line"),
            "indent",
            "levels",
            F.col("_body_indent").alias("body_indent"),
        )
    )

    # Each header asks every lower level for its latest header, and answers at its own level.
    own = F.struct(F.col("indent").alias("level"), F.lit(1).alias("answers"))
    lower = F.transform(
        F.filter("levels", lambda level: level < F.col("indent")),
        lambda level: F.struct(level.alias("level"), F.lit(0).alias("answers")),
    )
    asked = ended.withColumn("ask", F.explode(F.concat(F.array(own), lower))).withColumn("level", F.col("ask.level"))
    header = F.struct("start_line", "end_line", "kind", "name", "indent", "body_indent")
    earlier = (
        Window.partitionBy(*FILE, "level").orderBy("start_line").rowsBetween(Window.unboundedPreceding, -1)
    )
    latest = F.last(F.when(F.col("ask.answers") == 1, header), ignorenulls=True).over(earlier)
    answered = asked.withColumn("_latest", F.when(F.col("ask.answers") == 0, latest)).withColumn(
        "_outer", F.when(F.col("_latest.end_line") >= F.col("start_line"), F.col("_latest"))
    )
    nested = answered.groupBy(*FILE, "start_line").agg(
        *[F.first(c).alias(c) for c in ("kind", "name", "end_line", "indent", "body_indent")],
        F.sort_array(F.collect_list("_outer")).alias("_outers"),
    )
    outer = F.element_at("_outers", 1)
    scope = (
        F.when((F.size("_outers") == 0) & (F.col("indent") == 0), "top")
        .when(
            (F.size("_outers") == 1)
            & (outer["kind"] == "class")
            & (outer["indent"] == 0)
            & (F.col("indent") == outer["body_indent"]),
            "method",
        )
        .otherwise("inner")
    )
    span = "struct<start_line:int,end_line:int,name:string>"
    functions_around = F.transform(
        F.filter("_outers", lambda block: block["kind"] == "def"),
        lambda block: F.struct(block["start_line"], block["end_line"], block["name"]).cast(span),
    )
    return nested.select(
        *FILE,
        "kind",
        "name",
        "start_line",
        "end_line",
        "indent",
        F.concat(functions_around, F.array(F.struct("start_line", "end_line", "name").cast(span))).alias("chain"),
        F.when(F.size("_outers") < 2, scope).otherwise("inner").alias("scope"),
    )


def functions(all_blocks: DataFrame) -> DataFrame:
    return all_blocks.filter("kind = 'def'").drop("kind")


def definitions(all_functions: DataFrame) -> DataFrame:
    """What a name of a file stands for: its first module function or method of a top-level class."""
    return (
        all_functions.filter("scope IN ('top', 'method')")
        .groupBy(*FILE, "name")
        .agg(F.min_by(F.struct("start_line", "end_line"), "start_line").alias("_def"))
        .select(*FILE, "name", "_def.start_line", "_def.end_line")
    )


def import_statements(logical: DataFrame, lines: DataFrame) -> DataFrame:
    """Top-level import statements in order: ``stmt_no, statement``.

    ``from __future__`` lines are directives, not imports.
    """
    order = Window.partitionBy(*FILE).orderBy("ln")
    spans = logical.withColumn("_until", F.coalesce(F.lead("prev_code_ln").over(order), F.col("last_code_ln")))
    tops = spans.filter((F.col("indent") == 0) & F.col("code").rlike(rf"{NOT_AFTER_WORD}import{NOT_BEFORE_WORD}"))
    text = tops.select(*FILE, "ln", "_until").join(lines, FILE)
    masked = F.array_join(F.slice("masked_lines", F.col("ln"), F.col("_until") - F.col("ln") + 1), "\n")
    raw = F.array_join(F.slice("raw_lines", F.col("ln"), F.col("_until") - F.col("ln") + 1), "\n")
    last_comment = F.length(F.element_at("raw_lines", F.col("_until"))) - F.length(
        F.element_at("masked_lines", F.col("_until"))
    )
    # Statements that share a line are taken from the masked text, others as they stand.
    whole = F.substr(raw, F.lit(1), F.length(raw) - last_comment)
    parts = F.when(masked.contains(";"), F.split(masked, ";")).otherwise(F.array(whole))
    found = text.select(*FILE, "ln", F.posexplode(parts).alias("part", "statement")).withColumn(
        "statement", F.regexp_replace("statement", r"^\s+|\s+$", "")
    )
    return found.filter(
        F.col("statement").rlike(IMPORT) & ~F.col("statement").rlike(r"^from\s+__future__(?![\p{L}\p{N}_])")
    )


def import_heads(lines: DataFrame) -> DataFrame:
    """``raw_lines`` and ``masked_lines`` of each file as far as :func:`import_statements` needs them.

    A statement ends before the next logical line. Behind the last line that may be an import at the margin the first
    ``def`` or ``class`` that no string and no backslash reaches into is one, whatever stands above it, so what comes
    after it tells nothing about imports. Files without such a line keep all their lines, and so do files that share
    their path, as their lines are read as those of one file.
    """
    again = few(lines.groupBy(*FILE).agg(F.count("*").alias("n")).filter("n > 1").select(*FILE)).withColumn("_again", F.lit(True))
    masked = F.col("masked_lines")

    def may_import(line: Column) -> Column:
        return line.contains("import") & ~line.rlike(rf"^[ \t]+[^ \t\f{OPEN}]")

    def begins(line: Column, above: Column) -> Column:
        header = (line.contains("def") | line.contains("class")) & line.rlike(HEADER)
        return header & ~above.endswith(OPEN) & ~F.rtrim(F.translate(above, OPEN, "")).endswith("\\")

    def until(last: Column) -> Column:
        behind = F.transform(masked, lambda line, i: F.when((i >= last) & begins(line, F.get(masked, i - 1)), i + 1))
        return F.when(last.isNull(), 0).otherwise(F.coalesce(F.array_min(behind), F.size(masked)))

    last = F.array_max(F.transform(masked, lambda line, i: F.when(may_import(line), i + 1)))
    until_line = F.when(F.col("_again"), F.size(masked)).otherwise(let(last, until))
    kept = lines.join(again, FILE, "left").select(*FILE, "raw_lines", "masked_lines", until_line.alias("_until"))
    return kept.select(*FILE, *[F.slice(c, F.lit(1), F.col("_until")).alias(c) for c in ("raw_lines", "masked_lines")])


def imports_text(statements: DataFrame) -> DataFrame:
    """Per file its import statements as one text; files without any have no row."""
    ordered = F.sort_array(F.collect_list(F.struct("ln", "part", "statement")))
    return statements.groupBy(*FILE).agg(
        F.array_join(F.transform(ordered, lambda s: s["statement"]), "\n").alias("imports")
    )


def imports_map(statements: DataFrame, follow_alias: bool = False) -> DataFrame:
    """Imported name → module per file, the last import of a name wins: ``name, module, target``.

    ``target`` is the name to look for in the module. It is the local name even for
    ``from m import a as b`` (where a lookup of ``b`` fails), unless ``follow_alias`` is set.
    """
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace("statement", r"#[^\n]*", ""), r"[\\()]", " "), r"\s+", " ")
    is_from = F.col("flat").startswith("from")
    module = F.regexp_replace(F.regexp_extract("flat", r"^from (.*?) ?import ", 1), " ", "")
    listed = F.when(is_from, F.regexp_replace("flat", r"^from .*? ?import ", "")).otherwise(
        F.regexp_replace("flat", r"^import ", "")
    )
    items = (
        statements.withColumn("flat", F.concat(F.trim(flat), F.lit(" ")))
        .select(*FILE, "ln", "part", is_from.alias("is_from"), module.alias("source"), F.posexplode(F.split(listed, ",")).alias("item_no", "item"))
        .withColumn("item", F.trim("item"))
        .filter((F.col("item") != "") & (F.col("item") != "*"))
    )
    real = F.trim(F.substring_index("item", " as ", 1))
    alias = F.when(F.col("item").contains(" as "), F.trim(F.substring_index("item", " as ", -1)))
    local = F.when(F.col("is_from"), F.coalesce(alias, real)).otherwise(
        F.coalesce(alias, F.substring_index(real, ".", 1))
    )
    target = F.when(F.col("is_from"), real) if follow_alias else local
    named = items.select(
        *FILE,
        local.alias("name"),
        F.struct("ln", "part", "item_no").alias("_order"),
        F.struct(
            F.when(F.col("is_from"), F.col("source")).otherwise(real).alias("module"),
            F.coalesce(target, local).alias("target"),
        ).alias("_import"),
    )
    return named.groupBy(*FILE, "name").agg(F.max_by("_import", "_order").alias("_import")).select(
        *FILE, "name", "_import.module", "_import.target"
    )


def call_names(masked: Column) -> Column:
    """Names called in a masked piece of code, as the syntax tree's pre-order meets them, each once.

    A call comes before the calls in its callee and arguments: ``a.b(x()).c(y())`` calls c, b, x, y.
    So calls go by where their expression begins, and of those that begin together the outermost, which is
    the last in the text, goes first. Keywords and builtins are left out, and so are callees without a
    name, as in ``f()()`` the second.
    """
    patterns = r"(?m:^[ \t]*case\s[^\n]*?(?:\sif\s|:[ \t]*$))"
    tokens = F.regexp_extract_all(F.regexp_replace(masked, patterns, " "), F.lit(TOKENS), F.lit(1))
    return _called_names()(tokens)


# What an expression so far ends with: a name that can be called, another value, the dot after one, a
# string, the closing brace of an f-string's field, the head of a definition, or nothing to go on from.
_NAME, _VALUE, _DOT, _TEXT, _FIELD, _HEAD, _NONE = "name", "value", "dot", "text", "field", "head", "none"


def _called_names() -> Callable[[Column], Column]:
    """Names called in the tokens of a piece of code; like :func:`_layout_problem` a loop that goes by value."""
    keywords, builtins, quotes = frozenset(KEYWORDS), frozenset(KNOWN_BUILTINS), (QUOTED, OPEN)
    goes_on, texts = (_NAME, _VALUE, _TEXT, _FIELD), (_TEXT, _FIELD)
    name_, value_, dot_, text_, field_, head_, none_ = _NAME, _VALUE, _DOT, _TEXT, _FIELD, _HEAD, _NONE

    def names(tokens: list[str] | None) -> list[str] | None:
        if tokens is None:
            return None
        # ``start`` is where the expression at hand begins, ``outer`` those around open brackets
        start, last, name, outer, calls = -1, none_, "", [], []
        for at, token in enumerate(tokens):
            if token in ("(", "[", "{"):
                field = token == "{" and last in texts
                if token == "(" and last == name_:
                    calls.append((start, -at, name))
                begun = start if (token != "{" or field) and last in goes_on else at
                outer.append((begun, field_ if field else value_))
                start, last = -1, none_
            elif token in (")", "]", "}"):
                start, last = outer.pop() if outer else (-1, none_)
            elif token == ".":
                start, last = start if last in goes_on else at, dot_
            elif token == "\n" and outer:
                # inside brackets a line break means nothing
                continue
            else:
                kind = unicodedata.category(token[0])[0]
                if (kind == "L" or token[0] == "_") and token not in keywords:
                    start, last, name = start if last == dot_ else at, value_ if last == head_ else name_, token
                elif token.startswith(quotes):
                    start, last = start if last == dot_ or last in texts else at, text_
                elif kind == "N":
                    start, last = start if last == dot_ else at, value_
                else:
                    start, last = -1, head_ if token in ("def", "class") else none_
        return [n for n in dict.fromkeys(name for _, _, name in sorted(calls)) if n not in builtins]

    return F.udf(names, "array<string>", useArrow=True)


def source_between(lines: Column, start: Column, end: Column) -> Column:
    """Lines of a definition; its first line starts at ``def``, without the indent."""
    taken = F.slice(lines, start, end - start + 1)
    return F.transform(taken, lambda line, i: F.when(i == 0, F.regexp_replace(line, r"^[ \t\f]+", "")).otherwise(line))
