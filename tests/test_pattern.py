"""Written patterns: conclusions, argument heads, uses, terms and powers."""

import json

import pytest

from lemmata.pattern import Known, parse, powers_of_statement
from lemmata.query import Power


def heads(text):
    return ["_" if not a.names else a.names[0] if len(a.names) == 1 else a.names for a in parse(text).query.args]


def shape(text):
    return parse(text).query.concl, heads(text)


def asked(text):
    return json.loads(parse(text).query.term)


@pytest.mark.parametrize(
    "text, concl, args",
    [
        ("Real.exp _ ≤ _", "LE.le", ["Real.exp", "_"]),
        ("Finset.sum s f = Real.exp x", "Eq", ["Finset.sum", "Real.exp"]),
        ("a <= b", "LE.le", ["_", "_"]),
        ("List.Lex r [] (a :: l)", "List.Lex", ["_", "List.nil", "List.cons"]),
        ("Nat.succ _ + _", "HAdd.hAdd", []),
        ("¬ Nat.succ _ = 0", "Not", ["Eq"]),
        ("¬ (_ ∈ _) ↔ _ ∉ _", "Iff", ["Not", "Not"]),
        ("_ ∉ _", "Not", ["Membership.mem"]),
        ("∃ n : Nat, n = 0 → Nat.succ n = 1", "Exists", []),
        ("_ ∧ ∀ n : Nat, n = 0 → n = 0", "And", ["_", "_"]),
        ("_ ∧ ∃ n : Nat, n = 0 ∨ n = 1", "And", ["_", "Exists"]),
        ("-x ^ 2", "Neg.neg", []),
        ("-x * x", "HMul.hMul", []),
        ("!p && q", "Bool.and", ["Bool.not", "_"]),
        ("!_ == _", "Bool.not", ["BEq.beq"]),
        ("(~~~ _) = ~~~ _", "Eq", ["Complement.complement"] * 2),
        ("[0] = [_, _]", "Eq", ["List.cons", "List.cons"]),
        ("[] ++ [] = _", "Eq", ["HAppend.hAppend", "_"]),
        ("[_, _].length = 2", "Eq", [".length", "OfNat.ofNat"]),
        ("_ = if _ then _ else if _ then _ else _", "Eq", ["_", "ite"]),
        ("_ + (if _ ≤ _ then 1 else 0) = _", "Eq", ["HAdd.hAdd", "_"]),
        ("Nat.succ _ ∈ _ :: _", "Membership.mem", ["List.cons", "Nat.succ"]),
        ("Nat.succ _ ≍ Nat.succ _", "HEq", ["_", "Nat.succ", "_", "Nat.succ"]),
        ("(fun n => n, 0) = (_, _)", "Eq", ["Prod.mk", "Prod.mk"]),
        ("⟨0, proof⟩ = _", "Eq", ["_", "_"]),
        ("{ byteIdx := n } = _", "Eq", ["_", "_"]),
        ("SearchFixture.TypePred (Nat → Nat)", "SearchFixture.TypePred", ["_"]),
        ("SearchFixture.TypePred { id : Nat // id = id }", "SearchFixture.TypePred", ["Subtype"]),
        ("SearchFixture.TypePred ()", "SearchFixture.TypePred", ["_"]),
        ("SearchFixture.TypePred (Type _)", "SearchFixture.TypePred", ["_"]),
        ("'a' = _", "Eq", ["Char.ofNat", "_"]),
        ('"Nat.succ + ∀ → [id]" = _', "Eq", ["_", "_"]),
        ("1.25e-3 = 0xff", "Eq", ["OfScientific.ofScientific", "OfNat.ofNat"]),
        ("0[i]? = xs[0]!", "Eq", ["GetElem?.getElem?", "GetElem?.getElem!"]),
        ("#[#[n], #[]] = _", "Eq", ["List.toArray", "_"]),
        ("#[n].size = _", "Eq", [".size", "_"]),
        ("|a + b| ≤ |a| + |b|", "LE.le", ["abs", "HAdd.hAdd"]),
        ("‖Real.exp _‖ = _", "Eq", ["Norm.norm", "_"]),
        ("⟪x, y⟫_ℝ = _", "Eq", ["Inner.inner", "_"]),
        ("Real.log x⁻¹ = _", "Eq", ["Real.log", "_"]),
        ("a⁻¹ + b⁻¹ = _", "Eq", ["HAdd.hAdd", "_"]),
        ("a - b + c = f ⁻¹' s", "Eq", ["HAdd.hAdd", "Set.preimage"]),
        ("p.1 x = _", "Eq", ["_", "_"]),
        ("h.symm h' = _", "Eq", [(".symm", "DFunLike.coe"), "_"]),
        ("⇑f = ↑x", "Eq", ["DFunLike.coe", "_"]),
        ("↑n + 1 = 0", "Eq", ["HAdd.hAdd", "OfNat.ofNat"]),
        ("∑ i ∈ s, f i = _", "Eq", ["Finset.sum", "_"]),
        ("∀ {a b : Int}, |a + b| ≤ |a| + |b|", "LE.le", ["abs", "HAdd.hAdd"]),
        ("let id := Nat.succ 0; id = id", "Eq", ["_", "_"]),
        ("_ = _ → _ = _ ↔ _ = _", "Iff", ["_", "Eq"]),
        (".length l = _", "Eq", [".length", "_"]),
        ("(_ != _) = true", "Eq", ["bne", "true"]),
    ],
)
def test_shapes(text, concl, args):
    for t in (text, f"({text})", f"(({text}))"):
        assert shape(t) == (concl, args), t
    assert not parse(text).unknown


@pytest.mark.parametrize("range_, head", [(f"{a}{d}{b}", f"Std.R{x}{y}.mk") for a, d, x in (("m", "...", "c"), ("m", "<...", "o"), ("", "*...", "i")) for b, y in (("n", "o"), ("<n", "o"), ("=n", "c"), ("*", "i"))])
def test_ranges(range_, head):
    assert shape(f"({range_}) = ({range_})") == ("Eq", [head, head])


@pytest.mark.parametrize("sign, head", [("<*>", "Seq.seq"), ("<*", "SeqLeft.seqLeft"), ("*>", "SeqRight.seqRight"), (">>", "HAndThen.hAndThen"), ("<$>", "Functor.map"), ("&&", "Bool.and"), ("^^", "Bool.xor"), ("|||", "HOr.hOr"), ("<<<", "HShiftLeft.hShiftLeft"), ("==", "BEq.beq")])
def test_signs(sign, head):
    q = parse(f"(a {sign} b) = (a {sign} b)").query
    assert [a.names for a in q.args] == [(head,)] * 2 and q.uses == ()


@pytest.mark.parametrize(
    "text, uses",
    [
        ("Finset.sum s f = Real.exp x", ()),
        ("List.length [_, _] = 2", ("List.cons",)),
        ("Nat.succ (List.length _) = _", ("List.length",)),
        ("Real.exp (x + y) = _", ("HAdd.hAdd",)),
        ("Nat.Prime p → Nat.succ _ = _", ("Nat.Prime",)),
        ("a ∈ s → s ⊆ t → Nat.succ _ = _", ("Membership.mem",)),
        ("∀ id : Nat, id + id = id + id", ()),
        ("(∀ Nat : Type, ∀ n : Nat, n = n) ∧ Nat.succ 0 = 1", ("Nat.succ",)),
        ("(let id := Nat.succ 0; id = id) ∧ id _ = _", ("Nat.succ", "id")),
        ("∃ (Carrier : Type) (value : Carrier), True", ("True",)),
        ("{ toFin := Fin.ofNat _ _ } = _", ("Fin.ofNat",)),
        ("x + -1 = -1", ()),
        ("(List.map (fun n => match n with | 0 => 0 | n + 1 => n) _).reverse = _", ("List.map",)),
        ("autoParam (_ = _) Nat.foo._auto_1 → Nat.succ _ = _", ("autoParam",)),
        ("inner ℝ (_ : ℂ) _ = _", ()),
        ("#[n][i]? = _", ("List.cons", "List.toArray")),
        ("↑(Nat.succ _) = 0", ("Nat.succ",)),
    ],
)
def test_uses(text, uses):
    assert tuple(u for u in parse(text).query.uses if u not in ("Eq", "Neg.neg")) == uses


def test_equal_readings():
    for a, b in [("0xff = _", "255 = _"), ("0001 = _", "1 = _"), ("1.2500 = _", "125e-2 = _"), ("1.25e+3 = _", "125e1 = _"), ("1.25e-3 = _", "0.00125 = _"), ("inner ℝ (_ : ℂ) _ = _", "inner Real (_ : Complex) _ = _"),
                 ("1.0e999999999999999999999999999999999999 = _", "10e999999999999999999999999999999999998 = _"), ("Nat.succ _ != 0", "Nat.succ _ ≠ 0"), ("a -> b = c", "a → b = c"),
                 ("Nat.succ _ = _ → (_ = _ → Nat.succ _ = _)", "Nat.succ _ = _ → _ = _ → Nat.succ _ = _"), ("forall id : Nat, id = 1", "∀ id : Nat, id = 1")]:
        assert parse(a).query == parse(b).query, a
    assert parse("ENNReal.ofReal _ = 1").query != parse("ENNReal.ofReal _ = 0").query
    assert parse("ENNReal.ofReal _ = _").query.term is None


def test_terms():
    assert asked("_ = -2")["args"][1] == {"head": "Neg.neg", "args": [{"literal": "2"}]}
    t = asked("inner ℝ (_ : ℂ) _ = _")["args"][0]
    assert t["head"] == "inner" and t["args"] == [{"head": "Real"}, {"ty": {"head": "Complex"}}, {}]
    assert asked("⇑e.symm (e x) = x")["args"][0]["head"] == "$coe"
    assert asked("x ^ 2 = 4")["args"][0]["power"] == 2
    assert parse("@Eq Nat _ _").query.implicit and parse("∀ n : Nat, @Eq Nat n n").query.implicit and not parse("Not (@Eq Nat n n)").query.implicit


def test_hypotheses_and_what_is_told():
    counts = {"∀ (f : Nat → Nat) (n : Nat), f n = f n": 0, "∀ [inst : Inhabited (Nat → Nat)], Nat.succ _ = _": 0, "(_ = _ ↔ _ = _) → _ = _": 1, "∀ n : Nat, n = 0 → n = 0": 1, "p → q ↔ r": 0}
    for text, n in counts.items():
        assert parse(text).hypotheses == n, text
    assert parse("Finset.sum s f = Real.exp x").variables == ("f", "s", "x")
    assert parse("(fun n => n, 0) = _").lambdas == ("fun n => n",)
    assert parse("a § b = c").unknown == ("§",) and parse("#[n = _").unknown and parse("|a + b ≤ c").unknown == ("|",)
    assert parse("donut hole").query.concl == "donut" and parse("x y").query.text == ("x", "y")


def test_powers():
    square = lambda text: parse(text).query.powers
    assert square("x * x = x ^ 2") == ((0, Power(2, "HMul.hMul")), (1, Power(2, "HPow.hPow"))) == square("∀ id : Nat, id * id = id ^ 2")
    assert square("x * (x * x) = x ^ 2 * x") == ((0, Power(3, "HMul.hMul")), (1, Power(3, "HMul.hMul")))
    assert square("2 * x * x = x ^ n") == square("_ * _ = s.card * t.card") == ()
    assert square("_ ^ 2 = _") == ((0, Power(2, "HPow.hPow")),)
    assert square("_ ≍ x ^ 2")[0][0] == 3 and square("x ^ 2 ∈ _")[0][0] == 1
    assert powers_of_statement("∀ {f : ℕ → ℝ} (s : Finset ℕ), s.card * s.card = s.card ^ 2") == ([(0, Power(2, "HMul.hMul")), (1, Power(2, "HPow.hPow"))], False)


def test_maps_that_constants_return():
    known = Known({"fderiv": (3, True), "Nat.Coprime": (2, False)})
    for text in ("fderiv _ _ _ 1 = _", "(fderiv _ _ _) 1 = _"):
        r = parse(text, known)
        assert r.query.args[0].names == ("DFunLike.coe",) and r.query.uses == ("fderiv",) and r.coerced
    assert parse("(Nat.Coprime a) b", known).query.concl == "Nat.Coprime"
    assert parse("↑e x = x", Known({}, ("DFunLike.coe", "P.toFun"))).query.args[0].names == ("DFunLike.coe", "P.toFun")


@pytest.mark.parametrize("text", ["", "(", ")", "((((", "∀", "fun", "if", "[", "‖", "|||", "a = ", "= b", "→", "let", "@", "{ x", "⟨,", "x.", "\"open", "∑ i", "(a, ", "* ...", "xs[", "'"])
def test_nothing_is_too_odd(text):
    parse(text)
    parse(text * 3)


def test_nested_too_deeply():
    with pytest.raises(ValueError, match="deeply"):
        parse("(" * 5000 + "a = b")
    assert powers_of_statement("(" * 5000 + "a ^ 2 = b") == ([], False)
