"""Source text to declarations."""

from lemmata.sources import scanner

TEXT = '''/- Licence.
namespace Fake
theorem ghost : False := by sorry
/- nested
theorem deeper : False := sorry
-/
-/
import Alpha.Beta -- no second module
/-- Words like sorry and Real.log. -/
@[simp, grind =]
theorem real (n : Nat := 1) : Nat.succ 0 = n:=by
  -- sorry Real.sin
  rfl

namespace Outer
section Inner
private noncomputable def prose : String := "sorry /- Real.exp
theorem in_string : False := sorry"
def quote : Char := '"'
end Inner
@[to_additive (attr := simp)] lemma «a - b» : Foo.bar x' ∧ List.length l = 2
  | 0 => trivial

instance : Foo Bar where
  x := 1
theorem _root_.free.{u} : True := by sorry
mutual
inductive Tree where
  | leaf
end
theorem eq_1 : True := trivial
end
class inductive After (a : Type) where
'''


def test_scan():
    rows, anonymous = scanner.scan(TEXT)
    assert [(r.name, r.kind) for r in rows] == [
        ("real", "theorem"), ("Outer.prose", "def"), ("Outer.quote", "def"), ("Outer.«a - b»", "lemma"), ("free", "theorem"), ("Outer.Tree", "inductive"), ("After", "class inductive"),
    ]
    assert anonymous == 1
    by = {r.name: r for r in rows}
    assert by["real"].statement == "(n : Nat := 1) : Nat.succ 0 = n" and by["real"].doc == "Words like sorry and Real.log."
    assert by["real"].references == ["Nat", "Nat.succ"] and not by["real"].sorry
    assert by["real"].spelled == "theorem real (n : Nat := 1) : Nat.succ 0 = n"
    assert by["Outer.prose"].private and not by["Outer.prose"].sorry and (by["Outer.prose"].line_start, by["Outer.prose"].line_end) == (17, 18)
    assert by["Outer.«a - b»"].statement == ": Foo.bar x' ∧ List.length l = 2"
    assert by["Outer.«a - b»"].references == ["Foo.bar", "List.length", "«a - b»"]
    assert by["free"].sorry and by["Outer.Tree"].statement == "" and by["After"].statement == "(a : Type)"
    assert scanner.imports(TEXT) == ["Alpha.Beta"]
    assert scanner.imports("module\npublic import A\nmeta import B\nimport all C\nnamespace T\nimport D\n") == ["A", "B", "C"]
    assert scanner.scan("") == ([], 0)


def test_ranges():
    assert scanner.declares(" @[x] theorem a.b : T") and not scanner.declares("/-- theorem a -/\n  x := 1")
    assert scanner.declares("theorem b : T", "a.b") and not scanner.declares("theorem b : T", "a.c")
    assert scanner.declares("alias ⟨mp, mpr⟩ := iff", "N.mpr") and scanner.declares("irreducible_def integral : T", "M.integral")
    assert not scanner.declares("open integral", "M.integral") and scanner.declares("instance : Foo Bar", "any")
    assert scanner.first_code_line("/-- doc -/\n\n  x := 1") == "x := 1" and scanner.first_code_line("-- c") == "-- c"
    assert scanner.statement_only("/-- d -/ @[simp] theorem a : T") == "theorem a : T"


def test_corpus(spark, tmp_path):
    for path, text in {"A/B.lean": TEXT, ".git/X.lean": "theorem hidden : T := x\n", "html/Y.lean": "theorem noise : T := x\n", "C.lean": "lemma c : Outer.quote = real := free\n"}.items():
        (tmp_path / "corpus" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "corpus" / path).write_text(text)
    files = scanner.read(spark, str(tmp_path / "corpus"), "s", ("html",))
    assert {r.module for r in files.collect()} == {"A.B", "C"}
    rows = scanner.declarations(files)
    got = {r["name"]: r for r in scanner.resolve(rows, rows.select("name")).collect()}
    assert len(got) == 8 and got["c"]["deps"] == ["Outer.quote"] and got["c"]["kind"] == "theorem" and not got["c"]["elaborated"]
    assert got["real"]["deps"] == []
