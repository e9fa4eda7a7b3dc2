import ast
import os
import sysconfig

import pytest
from fixtures import LIMITS, STATIONS, UNITS, line_of, source_files
from pyspark.sql import functions as F

from winnow.operators import codeindex as C
from winnow.operators.context import build_contexts, is_degraded, module_candidates
from winnow.plans.triage import single_files

FINDING = (
    "finding_id string, repo_id string, file_path string, start_line int, end_line int, matched_code string"
)


def contexts(spark, rows, files):
    findings = spark.createDataFrame(rows, FINDING)
    return {r.finding_id: r for r in build_contexts(findings, files).collect()}


def at(needle, key=None, end=None, text=STATIONS, path="stations.py"):
    start = line_of(text, needle)
    return (key or needle, "met", path, start, end or start, text.splitlines()[start - 1])


@pytest.fixture(scope="module")
def met(spark):
    rows = [
        at("subprocess.run"),
        at("in_range(value)"),
        at("import subprocess"),
        at("nf.pad"),
        at("return celsius(station.level)", "nested"),
        at("return celsius(station.level)", "around", end=line_of(STATIONS, "return board.show")),
        at("return to_half"),
        ("missing", "met", "gone.py", 1, 1, "x = 1"),
    ]
    return contexts(spark, rows, source_files(spark))


def calls(row):
    return [(c.name, c.file_path, c.resolution_method) for c in row.context.called_functions]


def not_resolved(*names):
    return [f"Definition of `{name}()` not resolved." for name in names]


def test_plain_function(met):
    c = met["subprocess.run"].context
    first = line_of(STATIONS, "def maintenance")
    assert (c.containing_function_name, c.containing_function_start_line) == ("maintenance", first)
    assert c.containing_function_source == (
        f"{first} | def maintenance(command):\n{first + 1} |     subprocess.run(command, shell=True)  # flagged"
    )
    assert c.matched_code_with_lines == f"{first + 1} |     subprocess.run(command, shell=True)  # flagged"
    assert c.called_functions == [] and c.extraction_notes == not_resolved("run")


def test_method_with_calls_into_other_files(met):
    row = met["in_range(value)"]
    assert row.context.containing_function_name == "history"
    assert calls(row) == [("in_range", "limits.py", "same_module_import"), ("celsius", "units.py", "same_module_import")]
    assert row.context.called_functions[0].start_line == line_of(LIMITS, "def in_range")
    assert row.context.called_functions[1].source == "1 | def celsius(kelvin):\n2 |     return kelvin - 273.15"
    assert row.context.extraction_notes == not_resolved("deque", "poll", "push")


def test_decorated_method_with_calls_in_its_file(met):
    row = met["nf.pad"]
    assert row.context.containing_function_name == "summary"
    assert sorted(calls(row)) == [("history", "stations.py", "same_file"), ("newest", "stations.py", "same_file")]
    assert row.context.extraction_notes == not_resolved("pad")


def test_nested_function_and_what_surrounds_it(met):
    assert met["nested"].context.containing_function_name == "line_for"
    around = met["around"].context
    assert around.containing_function_name == "publish"
    # The nested function is not a lookup target, strings and comments hold no calls.
    assert [c.name for c in around.called_functions] == ["celsius"]
    assert sorted(around.extraction_notes) == sorted(not_resolved("line_for", "show"))


def test_name_imported_under_another(spark, met):
    assert met["return to_half"].context.extraction_notes == not_resolved("to_half")
    findings = spark.createDataFrame([at("return to_half")], FINDING)
    followed = build_contexts(findings, source_files(spark), follow_alias=True).first()
    assert [c.source.splitlines()[0] for c in followed.context.called_functions] == ["4 | def half_steps(value):"] or calls(followed)


def test_outside_any_function(met):
    c = met["import subprocess"].context
    assert (c.containing_function_name, c.containing_function_source) == (None, None)
    assert c.extraction_notes == [
        "Match is at module level (not inside any function or method); function context unavailable."
    ]


def test_file_that_is_not_there(met):
    c = met["missing"].context
    assert c.extraction_notes == ["Source file not found: gone.py"] and c.imports is None


def test_imports_block(met):
    assert met["subprocess.run"].context.imports.split("\n") == [
        "from .units import (",
        "    celsius,",
        "    half_steps as to_half,",
        ")",
        "import subprocess",
        "from collections import deque",
        "import numfmt as nf",
        "from limits import in_range, widest",
    ]


def test_a_file_given_twice_counts_once(spark):
    files = source_files(spark)
    doubled = files.unionByName(files).unionByName(source_files(spark, {"units.py": UNITS + "# more\n"}))
    assert sorted(r.path for r in single_files(doubled).collect()) == ["chart.html", "limits.py", "stations.py", "units.py"]
    assert single_files(files) is files


def test_large_file_and_degraded(spark):
    big = "def f():\n    g()\n" + "#" * (2 * 1024 * 1024)
    rows = [("big", "met", "big.py", 2, 2, "    g()")]
    findings, files = spark.createDataFrame(rows, FINDING), source_files(spark, {"big.py": big})
    whole = build_contexts(findings, files).first().context
    assert whole.containing_function_name == "f"
    found = build_contexts(findings, files, max_file_bytes=2 * 1024 * 1024)
    row = found.withColumn("degraded", is_degraded(F.col("context"))).first()
    assert row.context.extraction_notes == [
        f"File too large to parse ({len(big)} bytes); skipping AST-based extraction."
    ]
    assert row.degraded


def test_syntax_error_note(spark):
    text = "import os\nx = (1,\n\ndef f(a):\n    return g(a)\n"
    c = contexts(spark, [("k", "met", "bad.py", 5, 5, "return g(a)")], source_files(spark, {"bad.py": text}))["k"].context
    assert c.containing_function_name == "f"
    assert c.extraction_notes[0].startswith("File contains syntax errors")


PROBLEMS = {
    "if x\n  y": "colon",
    "def f(a)\n    pass\n": "colon",
    "class A\n  pass": "colon",
    "try\n": "colon",
    "while (a and\n  b)\n  c\n": "colon",
    "x = 'abc\ny = 1\n": "string",
    '"""abc\n': "string",
    "x = f'{y}\n": "string",
    "def f():\n        a\n    b\n": "dedent",
    "if x:\n\ta\n  b\n": "dedent",
    "if x:\ny\n": "block",
    "if x:": "block",
    "match x:\ny\n": "block",
    "a\n  b\n": "indent",
    "  a\n": "indent",
    "x = (1\n": "bracket",
    "x = 1)\n": "bracket",
    "x = (1]\n": "bracket",
    "x = (1,\n\ndef f(a):\n    return g(a)\n": "bracket",
    "": None,
    "\n\n  # c\n": None,
    "def f(): pass": None,
    "if x: y\nelse: z\n": None,
    "async def f(a: int = 1) -> {1: 2}:\n    pass\n": None,
    "f = lambda x: (\n  x)\nwhile lambda: 1: pass\n": None,
    "match x:\n  case 1:\n    y\n": None,
    "x = {1:\n 2}\n": None,
    "if (y := f(x)):\n  z\n": None,
    "x = 'a\\\nb'\n": None,
    "x = 1 + \\\n  2\n": None,
    "x = f'{a!r:>{w}}'\n": None,
    'if x:\n    """\ntext:\n  more\n"""\n    y\nelse:\r\n    z\r\n': None,
    "lambdas = 1\nformat: int\nelsewhere = [a[1:2] for a in b if a]\n": None,
}


def test_syntax_problems(spark):
    rows = spark.createDataFrame([(k,) for k in PROBLEMS], "code string")
    found = rows.select("code", C.syntax_problem(C.mask_code(F.col("code"))).alias("problem")).collect()
    assert {r.code: r.problem for r in found} == PROBLEMS
    for code, problem in PROBLEMS.items():
        if problem is None:
            ast.parse(code)
        else:
            with pytest.raises(SyntaxError):
                ast.parse(code)


def test_no_problem_where_the_parser_has_none(spark):
    root = sysconfig.get_path("stdlib")
    texts = {}
    for name in sorted(os.listdir(root)):
        if name.endswith(".py"):
            with open(os.path.join(root, name), encoding="utf-8") as f:
                texts[name] = f.read()
            ast.parse(texts[name])
    found = C.file_lines(source_files(spark, texts).repartition(8)).filter("problem IS NOT NULL").select("path", "problem")
    assert len(texts) > 100 and found.collect() == []


@pytest.mark.parametrize("code", ["if x\n    pass\n", "s = 'open\n", "if x:\n        a\n    b\n"])
def test_note_about_a_file_that_does_not_parse(spark, code):
    text = "import os\n" + code + "def f(a):\n    return g(a)\n"
    line = line_of(text, "return g(a)")
    c = contexts(spark, [("k", "met", "bad.py", line, line, "return g(a)")], source_files(spark, {"bad.py": text}))["k"].context
    assert c.extraction_notes == ["File contains syntax errors; extraction is best-effort and may be incomplete.", *not_resolved("g")]


def test_file_outside_the_repository_fails_the_context(spark):
    tree = {"a.py": "from ..up import go\n\ndef f():\n    go()\n", "../up.py": "def go():\n    pass\n"}
    row = contexts(spark, [("k", "met", "a.py", 4, 4, "go()")], source_files(spark, tree))["k"]
    assert row.context_error == "ValueError"


def test_import_from_a_repository_beside_this_one(spark):
    mine = {"pkg/a.py": "from ...other.m import go\nfrom ...gone.m import far\n\ndef f():\n    go()\n\ndef g():\n    far()\n"}
    beside = source_files(spark, {"m.py": "def go():\n    pass\n"}, repo_id="other")
    files = source_files(spark, mine).unionByName(beside)
    rows = [("k", "met", "pkg/a.py", 5, 5, "go()"), ("l", "met", "pkg/a.py", 8, 8, "far()")]
    got = contexts(spark, rows, files)
    assert got["k"].context_error == "ValueError" and got["l"].context_error is None
    assert got["l"].context.extraction_notes == not_resolved("far")


@pytest.mark.parametrize(
    "path,module,expected",
    [
        ("a/b/c.py", "x.y", ("x/y.py", "x/y/__init__.py")),
        ("a/b/c.py", ".d", ("a/b/d.py", "a/b/d/__init__.py")),
        ("a/b/c.py", "..d.e", ("a/d/e.py", "a/d/e/__init__.py")),
        ("a/b/c.py", ".", ("a/b.py", "a/b/__init__.py")),
        ("c.py", ".", (None, "__init__.py")),
        ("c.py", "..d", ("../d.py", "../d/__init__.py")),
        ("a/p.v1/c.py", ".", ("a/p.py", "a/p.v1/__init__.py")),
        ("c.py", "", (None, None)),
    ],
)
def test_module_candidates(spark, path, module, expected):
    row = spark.range(1).select(*module_candidates(F.lit(path), F.lit(module)).values()).first()
    assert tuple(row) == expected


def test_imports_map_and_alias(spark):
    text = "import a.b, c as d\nfrom .m import (x, y as z)  # note\nfrom q import *\nfrom __future__ import w\nimport x\n"
    files = source_files(spark, {"f.py": text})
    lines = C.file_lines(files)
    statements = C.import_statements(C.logical_lines(lines), lines)
    got = {r["name"]: (r.module, r.target) for r in C.imports_map(statements).collect()}
    assert got == {"a": ("a.b", "a"), "d": ("c", "d"), "z": (".m", "z"), "x": ("x", "x")}
    followed = {r["name"]: r.target for r in C.imports_map(statements, follow_alias=True).collect()}
    assert followed["z"] == "y"


# -- an independent check with the standard library's parser ---------------------------------------

MODULES = ["ast", "argparse", "dataclasses", "enum", "functools", "inspect", "pathlib/_local", "textwrap", "typing", "csv"]


def direct_calls(node):
    """Names in the order in which a walk of the tree from the top meets the calls."""
    skip = {id(x) for d in node.decorator_list for x in ast.walk(d)}
    calls = [c for c in ast.walk(node) if isinstance(c, ast.Call) and id(c) not in skip]
    calls.sort(key=lambda c: (c.lineno, c.col_offset, -c.end_lineno, -c.end_col_offset))
    names = [getattr(c.func, "id", None) or getattr(c.func, "attr", None) for c in calls]
    return list(dict.fromkeys(n for n in names if n and n not in C.KNOWN_BUILTINS))


CHAINS = {
    "a.b(x).c()": ["c", "b"],
    "f(g(h()), k())": ["f", "g", "h", "k"],
    "a.b(g(y)).c(h(z))": ["c", "b", "g", "h"],
    "f()(g())": ["f", "g"],
    "(a.b()).c()": ["c", "b"],
    "table[f(1)].g()": ["g", "f"],
    "await a.b().c(d())": ["c", "b", "d"],
    "x = (q\n  .filter(p())  # first()\n  .order('by(x)')\n  .every())": ["every", "order", "filter", "p"],
    "a.b() \\\n  .c()": ["c", "b"],
    "'%s'.join(f()).strip()": ["strip", "join", "f"],
    "f'{g(x)}{h(y)}'.upper()": ["upper", "g", "h"],
    "'a' 'b'.title(t())": ["title", "t"],
    "return f(x) if g(y) else -h(z)": ["f", "g", "h"],
    "{a(): b()}.get(c())": ["get", "a", "b", "c"],
    "def f(x=d()): return e(f(x))": ["d", "e", "f"],
    "class K(base()): pass": ["base"],
    "lambda: f()": ["f"],
    "a.b(1.5.hex(), x) if y.z () else w": ["b", "hex", "z"],
    "case(1)\nmatch.start()": ["case", "start"],
    ")]} f(g(": ["f", "g"],
    "": [],
}


def test_calls_in_the_order_of_the_tree(spark):
    rows = spark.createDataFrame([(k,) for k in CHAINS], "code string")
    got = {r.code: r.names for r in rows.select("code", C.call_names(C.mask_code(F.col("code"))).alias("names")).collect()}
    assert got == CHAINS


def test_a_long_function_with_many_calls(spark):
    body = "".join(f"    a_{i}(b_{i}()).c_{i}()\n" for i in range(3000)) + '    """' + "text\n" * 20_000 + '"""\n'
    code = spark.createDataFrame([("def f():\n" + body,)], "code string")
    names = code.select(C.call_names(C.mask_code(F.col("code"))).alias("names")).first().names
    assert names == [n for i in range(3000) for n in (f"c_{i}", f"a_{i}", f"b_{i}")]


def test_functions_and_calls_match_the_parser(spark):
    root = sysconfig.get_path("stdlib")
    texts = {}
    for name in MODULES:
        path = os.path.join(root, name + ".py")
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                texts[name] = f.read()
    texts["stations"], texts["units"] = STATIONS, UNITS
    lines = C.file_lines(source_files(spark, texts))
    found = C.functions(C.blocks(C.logical_lines(lines)))
    code = F.array_join(C.source_between(F.col("masked_lines"), F.col("start_line"), F.col("end_line")), "\n")
    rows = found.join(lines, C.FILE).select("path", "name", "start_line", "end_line", C.call_names(code).alias("calls"))
    got = {(r.path, r.name, r.start_line, r.end_line): r.calls for r in rows.collect()}
    want = {}
    for path, text in texts.items():
        for node in ast.walk(ast.parse(text)):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                want[(path, node.name, node.lineno, node.end_lineno)] = direct_calls(node)
    assert got.keys() == want.keys()
    different = [key for key in want if got[key] != want[key]]
    # Nested quotes inside f-string fields are the known gap.
    assert len(different) <= len(want) // 500, different


def test_lines_are_dealt_by_their_number(spark):
    """Masked lines shrink so much in a shuffle that its bytes say little about what a task sorts."""
    rows = [("r", f"{i}.py", 69_000, "x = 1\n" * 11_500) for i in range(90)]
    lines = C.file_lines(spark.createDataFrame(rows, "repo_id string, path string, length long, text string"))
    assert C.logical_lines(lines).groupBy(F.spark_partition_id()).count().count() == 6


def test_tokens_are_read_in_a_loop(spark):
    """No expression that is interpreted anew for every token."""
    files = spark.createDataFrame([("r", "a.py", 9, "def f(x):\n    return g(x)\n")], "repo_id string, path string, length long, text string")
    read = C.file_lines(files).select("problem", C.call_names(F.array_join("masked_lines", "\n")).alias("names"))
    assert "aggregate(" not in read._jdf.queryExecution().toString()
    assert [tuple(r) for r in read.collect()] == [(None, ["g"])]


HEADS = {
    "top": ("import os\nx = 1\n\ndef f():\n    import re\n    return re\n", 4),
    "none": ("def f():\n    import re\n", 0),
    "late": ("def f():\n    pass\nfrom a import (\n    b,\n)\n# def\nclass C:\n    pass\nlast = 1\n", 7),
    "last": ("def f():\n    pass\nimport a; import b", 3),
    "string": ('import a, b  # c\nx = """\ndef f():\n"""\ny = 1\ndef g(): pass\nz = 2', 6),
    "joined": ("from a import b as \\\ndef c\ny = 1\n\fimport d\n  def g(): pass\nz = 2", 5),
    "open": ("import a\nx = (1,\nimport b\nasync def f():\n    pass\n", 4),
    "word": ("important = 1\nimport a\nimported = 2\nx = 3\n", 5),
}


def test_imports_of_the_lines_that_can_tell(spark):
    files = [("r", path, code) for path, (code, _) in HEADS.items()] + [("r", "twice", HEADS["top"][0])] * 2
    df = spark.createDataFrame(files, "repo_id string, path string, text string")
    lines = C.file_lines(df)
    heads = C.import_heads(lines)
    kept = {r.path: r.n for r in heads.select("path", F.size("raw_lines").alias("n")).collect()}
    assert kept == {path: n for path, (_, n) in HEADS.items()} | {"twice": 7}
    assert heads.filter("size(raw_lines) != size(masked_lines)").count() == 0

    def found(given):
        rows = C.import_statements(C.logical_lines(given), given).collect()
        return sorted((r.path, r.ln, r.part, r.statement) for r in rows)

    assert found(heads) == found(lines)
    assert len(found(heads)) > 9
