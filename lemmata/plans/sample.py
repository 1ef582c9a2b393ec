"""A small library of declarations, for queries and tests that need statements and terms, which the driver's tables don't have."""

from __future__ import annotations

import json

MUL, POW, IP = "HMul.hMul", "HPow.hPow", "Inner.inner"


def n(head, *args, **more):
    return {"head": head, "args": list(args)} | more


def v(i, **more):
    return {"variable": i} | more


def row(i, name, concl, args, type_, consts=(), term=None, **more):
    """args: explicit heads; a type comes before them among all heads."""
    plain = dict(
        id=i, name=name, source="lib", module="M.Basic", kind="theorem", type=type_, concl=concl, concl_args=["_", *args], concl_explicit_args=list(args), term=term and json.dumps(term), deps=[], doc=None, sorry=False,
        line_start=10 * i, line_end=10 * i + 5, elaborated=True, unfolds=None, consts=sorted({concl, *args, *consts} - {"_", None}),
    )
    return plain | more


def library() -> list[dict]:
    """Rows that differ in what searches tell apart: powers and products, sides, unfoldings, texts, generated names."""
    x = v(0)
    return [
        row(1, "Real.exp_le_exp", "Iff", ["LE.le", "LE.le"], "∀ {x y : ℝ}, Real.exp x ≤ Real.exp y ↔ x ≤ y", ["Real.exp"], deps=["Real.exp_strictMono", "Real.exp"], module="M.Exp"),
        row(2, "Real.exp_monotone", "LE.le", ["Real.exp", "Real.exp"], "∀ {x y : ℝ}, x ≤ y → Real.exp x ≤ Real.exp y", deps=["Real.exp_strictMono"], module="M.Exp"),
        row(3, "mul_self_nonneg", "LE.le", ["OfNat.ofNat", MUL], "∀ {R : Type u} [inst : Semiring R] (a : R), 0 ≤ a * a", term=n("LE.le", {"literal": "0"}, n(MUL, x, x))),
        row(4, "sign_mul_nonneg", "LE.le", ["OfNat.ofNat", MUL], "∀ (r : ℝ), 0 ≤ r.sign * r", ["Real.sign"], term=n("LE.le", {"literal": "0"}, n(MUL, n("Real.sign", x), x))),
        row(5, "pow_three'", "Eq", [POW, MUL], "∀ {M : Type} (a : M), a ^ 3 = a * a * a", term=n("Eq", n(POW, x, {"literal": "3"}), n(MUL, n(MUL, x, x), x))),
        row(6, "sq_abs", "Eq", [POW, POW], "∀ {α : Type} [inst : Ring α] (a : α), |a| ^ 2 = a ^ 2", ["abs"], term=n("Eq", n(POW, n("abs", x), {"literal": "2"}), n(POW, x, {"literal": "2"}))),
        row(7, "mul_comm", "Eq", [MUL, MUL], "∀ {G : Type} (a b : G), a * b = b * a", term=n("Eq", n(MUL, x, v(1)), n(MUL, v(1), x))),
        row(8, "real_inner_self", "Eq", [IP, POW], "∀ {F : Type} (x : F), inner ℝ x x = ‖x‖ ^ 2", ["Norm.norm", "Real"], term=n("Eq", n(IP, n("Real"), x, x), n(POW, n("Norm.norm", x), {"literal": "2"}))),
        row(9, "inner_mul_le", "LE.le", [MUL, MUL], "∀ {F : Type} (x y : F), inner ℝ x y * inner ℝ x y ≤ inner ℝ x x * inner ℝ y y", [IP, "Real"], term=n("LE.le", n(MUL, n(IP, n("Real"), x, v(1)), n(IP, n("Real"), x, v(1))), n(MUL, n(IP, n("Real"), x, x), n(IP, n("Real"), v(1), v(1))))),
        row(10, "Box.induction", "Eq", ["PiLp", "_"], "∀ (x : PiLp), x = 0", kind="theorem"),
        row(11, "Euclid", None, [], "Type", kind="def", unfolds="PiLp"),
        row(12, "PiLp", None, [], "Type", kind="def", unfolds="WithLp", module="M.Space", line_start=1, line_end=30),
        row(13, "PiLp.proj", None, [], "PiLp → ℝ", kind="def", module="M.Space", line_start=3, line_end=8),
        row(14, "PiLp.proj.ctorIdx", "Eq", ["zeta", "_"], "zeta = 1", module="M.Space", line_start=4, line_end=4),
        row(15, "text_only", None, [], "(x : Foo) : x = x", source="notes", module="N.A", elaborated=False, deps=["Real.exp_le_exp"], kind="theorem", doc="About pi and Real.exp."),
        row(16, "Real.exp_strictMono", "StrictMono", ["Real.exp"], "StrictMono Real.exp", deps=["Real.exp"], module="M.Exp"),
        row(17, "My.square", "Eq", ["_", "_"], "∀ x, x = x", source="project", module="P.A", deps=["Real.exp_le_exp", "gone"], consts=["Real.exp", "Real.sqrt"]),
        row(18, "My.helper", "Eq", ["_", "_"], "∀ x, x = x", source="project", module="P.B", deps=["My.square"]),
        row(19, "Real.sqrt_exp", "Eq", ["_", "_"], "∀ x, f x = x", ["Real.exp", "Real.sqrt"]),
        row(20, "fderiv", "Map", [], "(𝕜 : Type) → (f : E → F) → (x : E) → Map", kind="def"),
        row(21, "instDFunLikeMap", "DFunLike", ["Map", "_"], "DFunLike Map _", kind="instance"),
        row(22, "fderiv_apply", "Eq", ["DFunLike.coe", "_"], "(fderiv 𝕜 f x) v = 0", ["fderiv"], term=n("Eq", n("DFunLike.coe", n("fderiv", v(0), v(1), v(2)), v(3)), {})),
    ]


#: Text of the module M.Space.
SPACE = "structure PiLp where\n  a : Nat\ndef PiLp.proj := 1\n" + "  x\n" * 40
