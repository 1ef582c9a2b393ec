"""Declarations read from source text, without a compiler: headers at column zero, and statements up to their bodies."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import kind_of

#: Words that begin a declaration, and those that may stand before them.
KEYWORDS = ("theorem", "lemma", "def", "abbrev", "instance", "structure", "class inductive", "class", "inductive", "axiom", "opaque")
MODIFIERS = ("private", "public", "meta", "protected", "noncomputable", "partial", "unsafe", "nonrec", "scoped", "local")
#: Commands that take a name and declare nothing.
STRUCTURAL = ("end", "namespace", "section", "open", "universe", "variable", "variables", "import", "export", "attribute", "set_option", "deriving")
#: Last components of names that a compiler makes up.
MADE_UP = (
    "rec", "recOn", "casesOn", "below", "brecOn", "binductionOn", "ibelow", "ndrec", "ndrecOn", "noConfusion", "noConfusionType", "toCtorIdx", "injEq", "inj",
    "eq_def", "sizeOf_spec", "sizeOf_inst",
)
#: Folders that are never read.
SKIPPED = (".git", ".lake", "build", "node_modules")

_LITERAL = re.compile(r"""/-|--[^\n]*|«[^»]*»?|"(?:\\.|[^"\\])*"?|(?<![\w'])'(?:\\.|[^\\\n])'""", re.S)
_COMMENT_ENDS = re.compile("/-|-/")
_MODIFIER = re.compile(rf"(?:{'|'.join(MODIFIERS)}) ")
_KEYWORD = re.compile(rf"({'|'.join(KEYWORDS)}) ")
_SCOPE = re.compile(r"(namespace)\s+(.*)|(section|end)(?:\s+(.*))?$|(mutual)$")
_NAME = re.compile(r"(?:«[^»]*»?|[^\s({\[:⦃⟨«])*")
_WORD = re.compile(r"(?:«[^»]*»?|[\w.'!?])+")
_BODY = re.compile(r"«[^»]*»?|(?P<open>[(\[{⦃⟨])|(?P<close>[)\]}⦄⟩])|(?P<cut>:=|(?<![\w'.!?])where(?![\w'.!?])|^[^\S\n]*\|)", re.M)
_IMPORT = re.compile(r"(?:public )?(?:meta )?import (?:all )?\s*(\S+)")
_COMMAND = re.compile(r"([a-z][\w!?']*)(?=[ \t]|$)")


def masked(text: str) -> tuple[str, set[int]]:
    """The text with comments and literals blanked, every position kept; and the lines on which a docstring opens."""
    out, docs, at = [], set(), 0
    while m := _LITERAL.search(text, at):
        end = m.end()
        if m[0] == "/-":
            if text.startswith("/--", m.start()):
                docs.add(text.count("\n", 0, m.start()))
            depth = 1
            while depth and (n := _COMMENT_ENDS.search(text, end)):
                depth += 1 if n[0] == "/-" else -1
                end = n.end()
            end = len(text) if depth else end
        out.append(text[at : m.start()])
        piece = text[m.start() : end]
        out.append(piece if piece[0] == "«" else re.sub(r"[^\r\n]", " ", piece))
        at = end
    return "".join(out) + text[at:], docs


def undecorated(line: str) -> str | None:
    """What follows the attributes and modifiers of a line; None for an indented line."""
    if line[:1] in (" ", "\t"):
        return None
    while True:
        if m := _MODIFIER.match(line):
            line = line[m.end() :]
        elif line.startswith("@["):
            depth = 0
            for m in re.finditer(r"[\[\]]", line):
                depth += 1 if m[0] == "[" else -1
                if not depth:
                    line = line[m.end() :].lstrip()
                    break
            else:
                return line
        else:
            return line


def header(line: str) -> tuple[str, str] | None:
    """Keyword of a declaration's first line, and what follows it."""
    m = _KEYWORD.match(undecorated(line) or "")
    return (m[1], m.string[m.end() :]) if m else None


def plain_name(name: str) -> str:
    """Without `_root_.` before it and quotes round ordinary words."""
    return re.sub(r"«([^\W\d][\w'!?]*)»", r"\1", name.removeprefix("_root_."))


def is_internal(name: str) -> bool:
    """Made by a compiler: nobody searches for it."""
    last = re.findall(r"(?:«[^»]*»|[^.«])+", name)[-1:] or [""]
    return not name or name[0] == "_" or "._" in name or "_@." in name or last[0] in MADE_UP or bool(re.fullmatch(r"(eq|proof|match)_[0-9]+", last[0]))


def body_start(code: str) -> int:
    """Where the body begins in masked text: a `:=`, a `where` or a `|` that opens a line, outside brackets."""
    depth = 0
    for m in _BODY.finditer(code):
        if m["open"]:
            depth += 1
        elif m["close"]:
            depth = max(0, depth - 1)
        elif m["cut"] and not depth:
            at = m.end() - 1 if m[0].endswith("|") else m.start()
            if at or m[0][-1] != "|":
                return at
    return len(code)


def references(code: str) -> tuple[list[str], bool]:
    """Dotted or capitalised names in masked text, sorted; and whether `sorry` is among its words."""
    found, words = set(), _WORD.findall(code)
    for w in words:
        if ("." in w.strip(".") and w.strip(".") == w) or w[0].isupper() or w[0] == "«":
            name = plain_name(w)
            if not is_internal(name) and not all(c.isnumeric() or c == "." for c in w):
                found.add(name)
    return sorted(found), "sorry" in words


@dataclass
class Declaration:
    name: str
    kind: str
    private: bool
    statement: str  # from after the name to the body
    spelled: str  # the same from the first line on, with white space collapsed
    doc: str | None
    references: list[str]
    sorry: bool
    line_start: int  # from 1, both included
    line_end: int


def _doc_above(lines: list[str], first: int) -> str | None:
    while first and lines[first - 1].startswith("@["):
        first -= 1
    if not first or not lines[first - 1].rstrip().endswith("-/"):
        return None
    opened = next((i for i in range(first - 1, -1, -1) if lines[i].lstrip().startswith("/--")), None)
    return None if opened is None else "\n".join(lines[opened:first]).strip().removeprefix("/--").removesuffix("-/").strip()


def scan(text: str) -> tuple[list[Declaration], int]:
    """Declarations of a file in order, and how many have no name of their own. Names that a compiler makes up are left out.

    Each line is classified once; a declaration ends before the next line that begins something, less blank lines.
    """
    code, docs = masked(text)
    lines, codes = ([x.removesuffix("\r") for x in t.split("\n")] for t in (text, code))
    starts: list[tuple[int, re.Match | tuple | None]] = []
    for i, line in enumerate(codes):
        rest = (undecorated(line) or "").rstrip()
        what = _SCOPE.match(rest) or header(line)
        if what or line.startswith(("open ", "variable", "@[")) or (i in docs and lines[i].startswith("/--")):
            starts.append((i, what))
    out, anonymous = [], 0
    scopes: list[tuple[str, bool]] = []
    for (first, what), after in zip(starts, [*(i for i, _ in starts[1:]), len(lines)], strict=False):
        if isinstance(what, re.Match):
            word, label = what[1] or what[3] or what[5], (what[2] or what[4] or "").strip()
            if word != "end":
                scopes.append((label, word == "namespace"))
            elif scopes and label in ("", scopes[-1][0]):
                scopes.pop()
        elif what:
            kind, rest = what
            last = max(i for i in range(first, after) if i == first or lines[i].strip())
            begin = len(codes[first]) - len(rest)
            begin += len(rest) - len(rest.lstrip())
            written = _NAME.match(codes[first], begin)[0]
            own = written.rstrip(".")
            if not own:
                anonymous += 1
                continue
            spaces = [n for n, named in scopes if named]
            name = plain_name(own) if own.startswith("_root_.") else plain_name(".".join([*spaces, own]))
            if is_internal(name):
                continue
            raw, syntax = "\n".join(lines[first : last + 1]), "\n".join(codes[first : last + 1])
            cut = begin + len(written)
            refs, sorry = references(syntax)
            modifiers = re.sub(r"@\[.*?\]\s*", "", codes[first][: begin - len(kind) - 1]).split()
            out.append(
                Declaration(
                    name, kind, "private" in modifiers, raw[cut:][: body_start(syntax[cut:])].strip(), " ".join(raw[: body_start(syntax)].split()),
                    _doc_above(lines, first), refs, sorry, first + 1, last + 1,
                )
            )
    return out, anonymous


def imports(text: str) -> list[str]:
    """Modules that a file's own head imports."""
    out = []
    for line in masked(text)[0].split("\n"):
        line = line.strip()
        if line in ("", "module", "prelude"):
            continue
        if not (m := _IMPORT.match(line)):
            break
        out.append(m[1])
    return out


def _code_lines(text: str) -> list[str]:
    return [line for line, code in zip(text.split("\n"), masked(text)[0].split("\n"), strict=True) if code.strip()]


def declares(text: str, name: str | None = None) -> bool:
    """Whether lines declare anything, or `name` in particular; the first line may be indented. A word at column zero before the name counts as a command that declares it."""
    for i, line in enumerate(_code_lines(text)):
        if found := header(line.lstrip() if not i else line):
            rest = found[1]
        elif name and (m := _COMMAND.match(undecorated(line) or "")) and m[1] not in STRUCTURAL:
            rest = m.string[m.end() :]
        else:
            continue
        rest = rest.lstrip()
        bound = rest[1:].split("⟩")[0].split(",") if rest.startswith("⟨") else [_NAME.match(rest)[0].rstrip(".")]
        bound = [b.strip().removeprefix("_root_.") for b in bound if b.strip()]
        if name is None or (found and not bound) or any(name == b or name.endswith("." + b) for b in bound):
            return True
    return False


def first_code_line(text: str) -> str:
    """First line that is no comment; else the first that isn't blank."""
    some = [x.strip() for x in (*_code_lines(text), *text.split("\n")) if x.strip()]
    return some[0] if some else ""


def statement_only(statement: str) -> str:
    """Without the docstring and the attributes before it."""
    return re.sub(r"\A(?:\s*(?:/-.*?-/|@\[[^\]]*\]))*\s*", "", statement, flags=re.S).rstrip()


def declarations(files: DataFrame) -> DataFrame:
    """Declaration rows (no id) of files (source, module, text): one task reads one file at a time.

    Files are dealt out first, by what they are: reading is slow, and a table of many small texts may lie in one row group, which one task would read alone.
    Rows are not elaborated and have no shape. consts are all names that the text refers to; resolve() finds which of them are dependencies.
    """

    def of(batches):
        for batch in batches:
            for source, module, text in zip(*(batch.column(c).to_pylist() for c in ("source", "module", "text")), strict=True):
                rows = [(source, module, d) for d in scan(text or "")[0]]
                cols = {
                    "name": [d.name for *_, d in rows], "source": [s for s, *_ in rows], "module": [m for _, m, _ in rows], "kind": [d.kind for *_, d in rows],
                    "type": [d.statement for *_, d in rows], "consts": [d.references for *_, d in rows], "doc": [d.doc for *_, d in rows],
                    "sorry": [d.sorry for *_, d in rows], "line_start": [d.line_start for *_, d in rows], "line_end": [d.line_end for *_, d in rows],
                    "statement": [d.spelled for *_, d in rows],
                }
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in cols.items()], list(cols))

    text, number = pa.string(), pa.int32()
    kinds = dict(name=text, source=text, module=text, kind=text, type=text, consts=pa.list_(text), doc=text, sorry=pa.bool_(), line_start=number, line_end=number, statement=text)
    schema = "name string, source string, module string, kind string, type string, consts array<string>, doc string, sorry boolean, line_start int, line_end int, statement string"
    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = files.select("source", "module", "text").repartition(tasks, F.xxhash64("source", "module", "text"))
    rows = dealt.mapInArrow(of, schema)
    return rows.withColumn("kind", kind_of(F.col("kind"))).withColumn("elaborated", F.lit(False))


def resolve(scanned: DataFrame, names: DataFrame) -> DataFrame:
    """scanned with deps: those of its consts that `names` (name) declares, less the row's own name."""
    key = ["source", "module", "name", "line_start"]
    used = scanned.select(*key, F.explode("consts").alias("const")).where("const <> name")
    known = used.join(names.select(F.col("name").alias("const")), "const", "left_semi")
    deps = known.groupBy(*key).agg(F.array_sort(F.collect_set("const")).alias("deps"))
    return scanned.join(deps, key, "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>")))


def read(spark: SparkSession, root: str, source: str, exclude: tuple[str, ...] = (), suffix: str = ".lean") -> DataFrame:
    """Files (source, module, text) below a folder; a file's path is its module's name. Folders in SKIPPED and `exclude` are left out."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}")
    top = root.rstrip("/").rsplit("/", 1)[-1]
    inner = F.regexp_replace(F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))"), rf"^.*?/\Q{top}\E/", "")
    files = files.select(F.lit(source).alias("source"), inner.alias("path"), F.col("value").alias("text"))
    for folder in (*SKIPPED, *exclude):
        files = files.where(~F.concat(F.lit("/"), "path").contains(f"/{folder}/"))
    return files.select("source", F.replace(F.expr(f"left(path, length(path) - {len(suffix)})"), F.lit("/"), F.lit(".")).alias("module"), "text")
