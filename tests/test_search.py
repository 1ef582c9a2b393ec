"""The engine over a small library of declarations: patterns, looks, diagnosis, show, graph, loading and what is printed."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lemmata import cli, config, render, vendor
from lemmata.engine import Engine, NotFound
from lemmata.functions.statements import explicit_arity, explicit_positions, lines_of, prints_bare, says
from lemmata.operators import graph, joins, store
from lemmata.operators import provenance as V
from lemmata.operators.looks import looks, turned
from lemmata.operators.powers import placed
from lemmata.pattern import parse
from lemmata.plans.sample import IP, MUL, POW, library, row
from lemmata.query import Arg, Power, Query
from lemmata.schema import DECL
from lemmata.sources import jsonl
from test_engine import decl, frame

@pytest.fixture(scope="module")
def engine(spark):
    sources = [V.Source("lib", "lake"), V.Source("project", "local", importable=False), V.Source("notes", "git")]
    return Engine(frame(spark, library()).coalesce(2).cache(), sources=sources, namespace="My", missing_module=lambda m: "package Std" if m.startswith("Std") else None)


def names(hits):
    return [r["name"] for r in hits.rows]


def test_patterns(engine):
    assert names(engine.find("Real.exp _ ≤ Real.exp _")) == ["Real.exp_monotone"]
    assert names(engine.find("_ ≤ _ ↔ _ ≤ _")) == ["Real.exp_le_exp"]
    assert names(engine.find("x = _", name="comm")) == ["mul_comm"]
    assert names(engine.find("fderiv _ _ _ v = _")) == ["fderiv_apply"]
    assert names(engine.find(uses=("Real.exp", "Real.sqrt"), limit=1)) == ["My.square"] and engine.find(uses=("Real.exp",), limit=1).truncated
    with pytest.raises(ValueError, match="§"):
        engine.find("a § b = c")
    with pytest.raises(ValueError):
        engine.find()


def test_words_that_print_for_constants(engine):
    found = engine.find("inner ℝ x x = _")
    assert names(found) == ["real_inner_self"] and found.read_as == {"inner": IP}
    found = engine.find("exp _ ≤ exp _")  # never printed without its namespace: a variable
    assert not found.read_as and found.variables == ["exp"] and "Real.exp_monotone" in names(found)
    found = engine.find("foo * bar = bar * foo")
    assert names(found) == ["mul_comm"] and set(found.variables) == {"foo", "bar"}


def test_text_to_uses(engine):
    found = engine.find(text=("Norm.norm",), kinds=("theorem",))
    assert found.text_as_uses == ["Norm.norm"] and names(found) == ["real_inner_self"]
    assert names(engine.find(text=("about pi",))) == ["text_only"]


def test_sides_and_powers(engine):
    found = engine.find("_ ^ 2 = inner ℝ x x")
    assert names(found) == ["real_inner_self"] and found.swapped
    assert names(engine.find("0 ≤ a * a")) [0] == "mul_self_nonneg"
    found = engine.find("0 ≤ a ^ 2")
    assert names(found) == ["mul_self_nonneg"] and found.respelled == (Power(2, POW),)
    found = engine.find("a * a * a = _")
    assert "pow_three'" in names(found)
    found = engine.find("inner ℝ x y ^ 2 ≤ _")
    assert names(found) == ["inner_mul_le"] and found.respelled


def test_looks_are_plain_queries():
    q = parse("x * x = f y").query
    assert [(lk.turned, lk.traded) for lk in looks(q)] == [(True, ()), (False, (Power(2, MUL),)), (True, (Power(2, MUL),))]
    assert turned(parse("a = b").query) is None and turned(parse("Foo.f a ≤ b").query) is None
    t = turned(parse("Foo.f 1 = b").query)
    assert t.args == (Arg(), Arg.read("Foo.f")) and json.loads(t.term)["args"][1]["head"] == "Foo.f"
    assert turned(replace(q, implicit=True)) is None


def test_unfolding(engine):
    found = engine.find("Euclid = _")
    assert engine.reducible_class("Euclid") == ["Euclid", "PiLp", "WithLp"]
    assert names(found) == ["Box.induction"] and found.unfolded == {"Euclid": ["PiLp"]}


@pytest.mark.parametrize(
    "asked, cause, has",
    [
        (dict(uses=("Foo.bar",)), "Barren", {"conditions": ["--uses Foo.bar"]}),
        (dict(kinds=("instance",), module="M.Exp", name="exp"), "InScope", {"held": 3}),
        (dict(pattern="LE.le _ _ ↔ Real.exp _"), "NoSuchShape", {}),
        (dict(pattern="Real.exp _ ≤ _", name="exp_le_exp"), "NamedElsewise", {"name": "Real.exp_le_exp", "on_a_side": True}),
    ],
)
def test_causes(engine, asked, cause, has):
    """More than the catalogue's miss_causes has."""
    found = engine.find(**asked)
    assert not found.rows and found.empty.cause == cause, found.empty
    assert {k: found.empty.what[k] for k in has} == has
    assert render.hits(found).startswith("no match")


def test_older_rows_without_instances(spark):
    rows = frame(spark, [decl(0, "a", kind="def"), decl(1, "b", kind="instance", elaborated=False)])
    assert Engine(rows).find(kinds=("instance",), elaborated=True, name="a").empty.cause == "InstancesAreDefs"


def test_missing_terms_are_an_error(spark):
    rows = frame(spark, [decl(0, "a", concl_args=["f", "OfNat.ofNat"], concl_explicit_args=["f", "OfNat.ofNat"], consts=["f", "OfNat.ofNat"], source="old")])
    with pytest.raises(ValueError, match="old"):
        Engine(rows).find("f _ = 1")


def test_show(engine):
    text = "structure PiLp where\n  a : Nat\ndef PiLp.proj := 1\n" + "  x\n" * 40
    engine.read_module = lambda source, module: text if module == "M.Space" else None
    s = engine.show("PiLp")
    assert s.import_line == "import M.Space" and s.lines.startswith("structure PiLp")
    assert engine.show("proj").asked == "proj" and engine.show("proj").row["name"] == "PiLp.proj"
    made = engine.show("PiLp.proj.ctorIdx")
    assert made.inside["name"] == "PiLp.proj" and made.lines is None
    assert engine.show("mul_comm").missing and engine.show("square").row["name"] == "My.square" and engine.show("My.square").import_line is None
    with pytest.raises(NotFound, match="not in the index"):
        engine.show("nope")
    with pytest.raises(NotFound, match="declarations end in"):
        engine.decls, was = engine.decls.unionByName(frame(engine.spark, [row(90, "Other.mul_comm.x", "Eq", [], "t"), row(91, "Third.x", "Eq", [], "t")])), engine.decls
        try:
            engine.show(".x")
        finally:
            engine.decls = was
    both = engine.show_many(["PiLp", "nope", "mul_comm"])
    assert isinstance(both[1], NotFound) and "import M.Basic" in render.shown_many(both) and render.shown_many([both[0]] * 2, True) == "import M.Space\n"


def test_graph_commands(engine):
    got = [(r["level"], r["name"]) for r in engine.deps("My.square", 2).collect()]
    assert got == [(1, "Real.exp_le_exp"), (2, "Real.exp_strictMono")]
    assert engine.deps("text_only").first()["approximate"]
    total = {r["source"]: (r["n"], r["theorems"]) for r in engine.closure("My.square").collect()}
    assert total == {"lib": (2, 2), None: (2, 0)}
    with pytest.raises(NotFound):
        engine.rdeps("Real.exp")
    rows, count = engine.rdeps("Real.exp_strictMono")
    assert count == 2 and [r["name"] for r in rows.collect()] == ["Real.exp_le_exp", "Real.exp_monotone"]
    assert engine.rdeps("Real.exp_le_exp", source="project")[1] == 1
    plan = {r["name"]: r["role"] for r in engine.frontier("My.helper").collect()}
    assert plan == {"My.helper": "materialize", "My.square": "materialize", "Real.exp_le_exp": "import", "gone": "missing"}
    assert "used by 2" in render.rdeps("x", rows.collect(), 2) and "depth 1 (1)" in render.deps("My.square", engine.deps("My.square").collect())
    assert "4 declarations" in render.closure("My.square", engine.closure("My.square").collect())


def test_import_closure(spark):
    imports = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("X", "A")], "module string, imported string")
    got = {r.module: r.level for r in graph.import_closure(imports, spark.createDataFrame([("A",)], "module string")).collect()}
    assert got == {"A": 0, "B": 1, "C": 2}


def test_vendor(engine, tmp_path):
    text = "\n".join(f"line {i}" for i in range(1, 400))
    rows = engine.frontier("My.helper").collect()
    files = vendor.plan(rows, "V", engine.sources, ["My.square", "My.helper"])
    assert [f.path for f in files] == ["V/Project/P/A.lean", "V/Project/P/B.lean"] and files[0].lines == 6
    assert "to materialize: 2 declaration(s) in 2 file(s), 12 lines" in render.plan(rows, files)
    read = lambda source, module: text
    assert vendor.write(files, ["M.Exp"], read, str(tmp_path)) == [f.path for f in files]
    written = (tmp_path / "V/Project/P/A.lean").read_text()
    assert "import M.Exp" in written and "line 170\nline 171" in written
    with pytest.raises(FileExistsError):
        vendor.write(files, [], read, str(tmp_path))
    assert vendor.write(files, [], read, str(tmp_path), force=True)
    (tmp_path / "I.lean").write_text("import A\nimport B\n\ndef x := 1\n")
    assert vendor.add_imports(str(tmp_path / "I.lean"), ["B", "C"]) == ["C"]
    assert (tmp_path / "I.lean").read_text() == "import A\nimport B\nimport C\n\ndef x := 1\n"


def test_near_duplicates(engine, spark):
    scanned = spark.createDataFrame([("mine", "theorem", None, ["Real.exp", "Real.sqrt", "Eq"]), ("plain", "theorem", None, ["Eq"]), ("d", "def", None, ["Real.exp"])], "name string, kind string, concl string, deps array<string>")
    got = [tuple(r) for r in engine.dup(scanned, "project", 0.5).select("name", "other", "rank").collect()]
    assert got == [("mine", "Real.sqrt_exp", 1)]
    assert "100%" in render.dup(engine.dup(scanned, "project", 0.5).collect(), {"mine": "x = x"})


def test_statements(spark):
    assert says("∀ {F : Type} [inst : Norm F] (x : F),\n  ‖x‖ = 0") == "∀ (x : F), ‖x‖ = 0" and says("∀ {r : ℝ}, r = r") == "r = r" and says("∀ x y, x = y") == "∀ x y, x = y"
    arities = {"∀ (w z : ℂ), inner ℝ w z = 0": 2, "(𝕜 : Type) → (f : E → F) → (x : E) → Map": 3, "Nat → Nat → Prop": 2, "∀ {α : Type} [inst : X α], List α → Nat": 1, "(Nat → Nat) → Nat": 1, "a (b": None, "Nat": 0, "∀ x y, x = y": 2}
    assert {t: explicit_arity(t) for t in arities} == arities
    assert explicit_positions(["_", "f", "g"], ["f", "g"]) == [1, 2] and explicit_positions(["_", "_", "f"], ["_", "f"]) == [None, 2] and explicit_positions(["a"], ["b"]) is None
    df = spark.createDataFrame([("inner ℝ x x = 0",), ("X.inner x",), ("∀ (inner : Nat), inner = 0",), ("inner' x",), ("(a inner b : T)",), ("f inner!",)], "t string")
    assert [r.b for r in df.select(prints_bare(F.col("t"), "inner").alias("b")).collect()] == [True, False, False, False, False, False]
    assert df.limit(1).select(lines_of(F.lit("a\nb\nc"), F.lit(2), F.lit(9)).alias("x")).first().x == "b\nc"
    assert placed("@Eq Nat (a * a) b", "Eq", ["Nat", MUL, "_"], [MUL, "_"], False) == [(0, Power(2, MUL))]
    assert placed("a * a = b", "Eq", ["Nat", MUL, "_"], [MUL, "_"], True) == [(1, Power(2, MUL))] and placed("a * a = b", "Eq", ["Nat", MUL, "_"], None, True) == [(1, Power(2, MUL))]


def test_index(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = frame(spark, library()).coalesce(1)
    now = spark.createDataFrame([("lib", "r1", "s1")], "source string, revision string, stamp string")
    twice = rows.unionByName(rows.where("id = 3").withColumn("id", F.lit(99)))
    for source in ("lib", "notes"):
        handed, kept = store.load(twice, path, source, now)
    assert (handed, kept) == (1, 1)
    engine = Engine.open(spark, path, sources=[V.Source("lib", "local"), V.Source("notes", "git")])
    plain = Engine(rows.where("source <> 'project'"))
    assert engine.provenance("lib")["decls"] == 19 and engine.get("mul_self_nonneg")["id"] > 90
    for q in (Query(uses=("Real.exp", "Real.sqrt")), Query(text=("pi and",)), Query(text=("exp le",)), Query(uses=("Real.exp",), text=("x",)), Query(concl="Eq", uses=(IP,))):
        assert sorted(names(engine.find(q))) == sorted(names(plain.find(q))), q
    assert engine.is_constant("Norm.norm") and not engine.is_constant("Norm.nope")
    assert [(r["source"], r["why"]) for r in engine.stale(spark.createDataFrame([("lib", "r2")], "source string, revision string")).collect()] == [("lib", "moved")]
    assert engine.refreshable(spark.createDataFrame([("lib", "r2")], "source string, revision string")) == ["lib"]
    assert V.up_to_date(engine.provenance("lib"), "s1", 19) and not V.up_to_date(engine.provenance("lib"), "s2", 19) and not V.up_to_date(None, "s1", 0)
    out = engine.refresh(["lib", "bad"], lambda s: rows if s == "lib" else spark.table("no_such"), path, now)
    assert out["lib"] is None and "no_such" in out["bad"]
    spelled = spark.createDataFrame([("mul_comm", "lib", "M.Basic", "theorem mul_comm")], "name string, source string, module string, statement string")
    got = {r["name"]: r["statement"] for r in store.with_statements(rows, spelled).collect()}
    assert got["mul_comm"] == "theorem mul_comm" and got["sq_abs"] is None
    assert engine.located_in("notes").first()["name"] == "text_only" and engine.sources_of(Query(module="N")) == ["notes"]


def test_staleness(spark, tmp_path):
    schema = "source string, module string, name string, line_start int, line_end int, type string, statement string"
    build = spark.createDataFrame([("s", "A", "same", 1, 2, "t", "x = 1"), ("s", "A", "moved", 3, 4, "t", "y"), ("s", "B", "new", 1, 1, "t", "sum of squares"), ("s", "A", "longer", 1, 9, "t", "")], schema)
    index = spark.createDataFrame([("s", "A", "same", 1, 2, "t", ""), ("s", "Old", "moved", 3, 4, "t", ""), ("s", "A", "longer", 1, 2, "t", "")], schema)
    got = {r["name"]: r["why"] for r in V.behind(build, index).collect()}
    assert got == {"moved": "moved", "new": "new", "longer": "restated"}
    assert V.behind(build, index, spark.createDataFrame([("B",)], "module string")).count() == 1
    assert tuple(V.ahead(build, index).first()) == ("s", 2, 3)
    assert [r["name"] for r in V.declared_matching(build, text=("of squares",)).collect()] == ["new"] and V.declared_matching(build, name="MO*d", module="A").count() == 1
    packages = spark.createDataFrame([("std", "/p/./std/"), ("other", "/p/other")], "name string, path string")
    assert [r["name"] for r in V.unclaimed(packages, spark.createDataFrame([("/p/std",)], "path string")).collect()] == ["other"]
    assert [V.age(s) for s in (5, 600, 7200, 200_000)] == ["just now", "10m ago", "2h ago", "2d ago"]
    (tmp_path / "x.olean").write_text("abc")
    assert V.tree_stamp(str(tmp_path)) == V.tree_stamp(str(tmp_path)) and V.tree_stamp(str(tmp_path / "none")) is None and V.file_stamp(str(tmp_path / "x.olean")).startswith("3:")


def test_enclosing_in_bins(spark):
    import random

    rng = random.Random(1)
    spans = [(f"d{i:03}", "s", "M", a := rng.randint(1, 400), a + rng.choice([0, 1, 3, 15, 16, 17, 40, 200, 1000])) for i in range(150)]
    df = spark.createDataFrame(spans, "name string, source string, module string, line_start int, line_end int")
    want = {}
    for name, _, _, a, b in spans:
        outer = [(d - c, other) for other, _, _, c, d in spans if c <= a and d >= b and (c < a or d > b)]
        if outer:
            want[name] = min(outer)[1]
    assert {r["name"]: r["enclosing"] for r in joins.enclosing(df).collect()} == want


def test_enclosing_makes_no_pairs(spark):
    """Chains of spans round the same lines: each holds all before it. Pairs would be 72 million."""
    n = 6000
    rows = spark.range(n).select(F.concat(F.lit("d"), "id").alias("name"), F.lit("s").alias("source"), F.lit("M").alias("module"), (n - F.col("id")).cast("int").alias("line_start"), (n + F.col("id")).cast("int").alias("line_end"))
    rows = rows.unionByName(rows.withColumn("name", F.concat("name", F.lit("x"))))
    found = joins.enclosing(rows)
    assert found.agg(F.count("*"), F.count_if(F.concat(F.lit("d"), F.regexp_extract("name", "[0-9]+", 0).cast("int") + 1) == F.col("enclosing"))).first() == (2 * n - 2, 2 * n - 2)
    made, nodes = [], [found._jdf.queryExecution().executedPlan()]
    while nodes:
        x = nodes.pop()
        kids = [x.executedPlan()] if "AdaptiveSparkPlan" in x.nodeName() else [x.plan()] if "QueryStage" in x.nodeName() else [x.children().apply(i) for i in range(x.children().size())]
        nodes += kids
        if x.metrics().contains("numOutputRows"):
            made.append(x.metrics().apply("numOutputRows").value())
    assert "Join" in found._jdf.queryExecution().executedPlan().toString() and max(made) < 40 * 2 * n


def test_ids_follow_files_and_lines(spark, tmp_path):
    line = lambda name, **more: json.dumps(dict(name=name, source="s", module="M", kind="def", type="t", elaborated=True) | more)
    (tmp_path / "a.jsonl").write_text(line("a0") + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join(line(f"b{i}", doc="x" * 2000) for i in range(5)) + "\n")
    rows = jsonl.read(spark, str(tmp_path)).orderBy("id").collect()
    assert [r["name"] for r in rows] == ["a0", *(f"b{i}" for i in range(5))]
    again = jsonl.read(spark, str(tmp_path / "a.jsonl"), after=rows[-1]["id"]).first()
    assert again["id"] > rows[-1]["id"]


TOML = """[project]
namespace = "My"
imports = "I.lean"
vendor = "V"
[[source]]
name = "lib"
kind = "lake"
modules = ["M"]
[[source]]
name = "notes"
kind = "git"
path = "notes"
"""


def test_settings_and_commands(spark, tmp_path):
    c = config.parse(TOML)
    assert c.sources[0].source().can_import and not c.sources[1].source().is_compiled and config.parse(config.TEMPLATE)
    for bad in (TOML + "colour = 1\n", TOML.replace('"lake"', '"lakes"'), TOML.replace('namespace = "My"\n', ""), TOML.replace('"notes"\nkind', '"lib"\nkind'), TOML.replace('path = "notes"\n', "")):
        with pytest.raises(ValueError):
            config.parse(bad)
    (tmp_path / "lemmata.toml").write_text(TOML)
    (tmp_path / ".index/raw").mkdir(parents=True)
    rows = [{k: x for k, x in r.items() if k not in ("id", "term")} | ({"term": json.loads(r["term"])} if r["term"] else {}) for r in library() if r["source"] == "lib"]
    (tmp_path / ".index/raw/lib.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes/N.lean").write_text("/-- Says hello. -/\ntheorem hello : Real.exp 0 = 1 := by simp\n")
    run = lambda *words: cli.run(["--config", str(tmp_path / "lemmata.toml"), *words], spark)
    assert run("index") == "lib: 19 of 19 rows\nnotes: 1 of 1 rows\n"
    assert run("find", "0 ≤ a ^ 2").startswith("a power of 2 matched as a product\nmul_self_nonneg  theorem  M.Basic\n") and "1 result(s)" in run("find", "--text", "says hello")
    assert "import M.Basic" in run("show", "mul_comm") and "used by 2" in run("rdeps", "Real.exp_strictMono") and "20 declarations indexed" in run("status")
    assert "depth 1 (1)" in run("deps", "Real.exp_monotone") and "1 declarations in" not in run("deps", "Real.exp_monotone", "--depth", "all")
    assert cli.with_negation(["find", "-_ * _ = _", "--limit", "2"]) == ["find", "--limit", "2", "--", "-_ * _ = _"]
    with pytest.raises(SystemExit):
        run("show", "zzz", "--source", "nope")
