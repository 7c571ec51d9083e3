"""Multipart credential linking over whole texts, with column expressions only.

Parts of a credential are identifiers, secrets and endpoints, each an interval of code points. Strong
parts (assign, access, hex) are always reported. Weak ones say little alone and are reported only if
complementary parts lie within a scope of SCOPE code points: an identifier near a secret, a
passphrase near an identifier or an endpoint, an endpoint near both an identifier and a secret. This
interval join looks along the sorted parts of one text for the nearest end before and the nearest start
after of each role, in blocks, so no pairs are made and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import column, prefix, quoted

# The patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

#: Weak parts.
IDENT = r"""((?i:user_?name|user_?id|user|login|account_?id|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})"""
PHRASE = r"""((?i:passphrase|pass|pwd|private_?key|credential))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=!@#$%^&*-]{4,})"""
ENDPOINT = r"""(?i:(?:https?|ftp|jdbc:[a-z0-9]+|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}(?::[0-9]+)?)"""

KINDS = ("assign", "access", "hex", "ident", "phrase", "endpoint")
ROLE = {"assign": 2, "access": 1, "hex": 2, "ident": 1, "phrase": 2, "endpoint": 3}
SCOPE = 300
MASK = "[SECRET]"
#: Parts of a text that are read together when sums and extremes run over them.
BLOCK = 128
#: Gaps between masked spans up to which each is looked for from the start of its text.
FEW = 64

_PART = "struct<s:int,k:int,e:int>"
_NONE = f"cast(array() as array<{_PART}>)"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bound(value: str, name: str, body: str) -> str:
    """body with name standing for value, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _scan(values: str, whole: str, before: bool = True) -> str:
    """For each of an array of numbers what whole makes of those before it (after it) and of none at the ends.

    Two levels: of each block the others' results are joined once, and within it only its own rows are read, so a text
    of n parts takes n * BLOCK steps and not n * n. whole maps an array of numbers, which may be empty, to one number.
    """
    n = BLOCK
    own = "slice(v, k * {n} + 1, i)" if before else "slice(v, k * {n} + i + 2, greatest({n} - 1 - i, 0))"
    rest = "slice(w, 1, k)" if before else "slice(w, k + 2, size(w))"
    inner = f"flatten(transform(w, (x, k) -> {_bound(whole.format(rest), 'o', f'transform(slice(v, k * {n} + 1, {n}), (y, i) -> {whole.format(f"concat(array(o), {own.format(n=n)})")})')}))"
    blocks = f"transform(sequence(0, (size(v) - 1) div {n}), k -> {whole.format(f'slice(v, k * {n} + 1, {n})')})"
    return _bound(values, "v", f"if(size(v) = 0, v, {_bound(blocks, 'w', inner)})")


_SUM = "aggregate({}, 0, (a, b) -> a + b)"
_MOST = "coalesce(array_max({}), -1000000000)"
_LEAST = "coalesce(array_min({}), 2000000000)"


def _found(t: str, kind: str, pattern: str, least: str) -> str:
    """Intervals of all leftmost matches m (gaps are what split leaves between) for which least holds."""
    k = KINDS.index(kind)
    matches = f"filter(zip_with(regexp_extract_all({t}, {_sql(pattern)}, 0), split({t}, {_sql(pattern)}, -1), (m, gap) -> struct(m as m, length(gap) as g, length(m) as n)), x -> x.m is not null)"
    at = _scan("transform(z, x -> x.g + x.n)", _SUM)
    placed = f"zip_with(z, {at}, (x, p) -> if({least}, struct(p + x.g as s, {k} as k, p + x.g + x.n as e), null))"
    return f"filter({_bound(matches, 'z', placed)}, x -> x is not null)"


def _when(t: str, quick: str, found: str) -> str:
    return f"case when {quick} then {found} else {_NONE} end"


def base_parts(t: str) -> dict[str, str]:
    """SQL for the intervals of each base kind; quick tests keep most texts from the dear ones."""
    low = f"translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    named = " or ".join(f"contains({low}, '{x}')" for x in ("passw", "secret", "token", "api"))
    return {
        "assign": _when(t, f"({named})", _found(t, "assign", ASSIGN, f"length(regexp_extract(x.m, {_sql(ASSIGN)}, 2)) >= 8")),
        "access": _when(t, f"contains({t}, 'AKIA')", _found(t, "access", ACCESS, "length(x.m) >= 16")),
        # runs of 32 and more are found alike with the length in the pattern, and without the many short ones
        "hex": _when(t, f"{t} rlike '[0-9a-f]{{32}}'", _found(t, "hex", HEX[:-1] + "{32,}", "true")),
    }


def weak_parts(t: str) -> dict[str, str]:
    low = f"translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    has = lambda *x: "(" + " or ".join(f"contains({low}, '{y}')" for y in x) + ")"
    return {
        "ident": _when(t, has("user", "login", "account", "client", "access"), _found(t, "ident", IDENT, "true")),
        "phrase": _when(t, has("pass", "pwd", "private", "credential"), _found(t, "phrase", PHRASE, "true")),
        "endpoint": _when(t, has("://", "host", "endpoint", "server"), _found(t, "endpoint", ENDPOINT, "true")),
    }


def _role(k: str) -> str:
    return "case " + " ".join(f"when {k} = {i} then {ROLE[kind]}" for i, kind in enumerate(KINDS)) + " end"


def linked(parts: str) -> str:
    """The weak parts (k > 2) among sorted parts whose complement is in scope: by the nearest end before and the nearest start after, of each role."""
    near = []
    for r in (1, 2, 3):
        ends = _scan(f"transform(q, x -> if({_role('x.k')} = {r}, x.e, -1000000000))", _MOST)
        starts = _scan(f"transform(q, x -> if({_role('x.k')} = {r}, x.s, 2000000000))", _LEAST, before=False)
        near.append(f"zip_with(q, zip_with({ends}, {starts}, (e, s) -> struct(e, s)), (x, y) -> x.s - y.e <= {SCOPE} or y.s - x.e <= {SCOPE})")
    marked = f"zip_with(zip_with(q, {near[0]}, (p, n1) -> struct(p, n1)), zip_with({near[1]}, {near[2]}, (n2, n3) -> struct(n2, n3)), (x, y) -> struct(x.p as p, x.n1 as n1, y.n2 as n2, y.n3 as n3))"
    return f"filter({_bound(parts, 'q', marked)}, x -> (x.p.k = 3 and x.n2) or (x.p.k = 4 and (x.n1 or x.n3)) or (x.p.k = 5 and x.n1 and x.n2)).p"


def _coded(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.k + 1), ':', x.s, ':', x.e)), ',')"


def with_parts(docs: DataFrame, text: str = "text", p: str = "_") -> DataFrame:
    """docs with {p}assign, {p}access, {p}hex, {p}base and {p}spans: sorted arrays of struct(s, k, e), those of the base kinds, all of these, and all that are reported.

    No column of docs may begin with p.
    """
    t = f"coalesce({quoted(text)}, '')"
    d = docs.withColumns({p + k: F.expr(e) for k, e in base_parts(t).items()})
    d = d.withColumn(f"{p}base", F.expr(f"array_sort(concat({p}assign, {p}access, {p}hex))"))
    d = d.withColumns({p + k: F.expr(e) for k, e in weak_parts(t).items()})
    d = d.withColumn(f"{p}all", F.expr(f"case when size({p}ident) + size({p}phrase) + size({p}endpoint) > 0 then array_sort(concat({p}base, {p}ident, {p}phrase, {p}endpoint)) end"))
    d = d.withColumn(f"{p}spans", F.expr(f"case when {p}all is null then {p}base else array_sort(concat({p}base, {linked(f'{p}all')})) end"))
    return d.drop(f"{p}ident", f"{p}phrase", f"{p}endpoint", f"{p}all")


def find_secrets(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns carry of every row, with n_assign, n_access, n_hex, base_sha256 and spans.

    Spans are kind:start:end in code points, end exclusive, by start, then kind, then end. Null and empty texts
    have none (the hash is that of the empty string); very long texts are read whole. Repeated rows stay; an empty
    table gives an empty result; the other columns of the input are not read, so they may have any name, and a
    carried one named as a new one gives way to it.
    """
    made = [*(f"n_{k}" for k in KINDS[:3]), "base_sha256", "spans"]
    d = with_parts(docs.select(*(column(c).alias(f"c{i}") for i, c in enumerate(carry)), column(text).alias("text")))
    return d.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry) if c not in made),
        *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.expr(f"sha2({_coded('_base')}, 256)").alias("base_sha256"),
        F.expr(_coded("_spans")).alias("spans"),
    )


def mask(docs: DataFrame, text: str = "text", word: str = MASK) -> DataFrame:
    """docs, each reported span of the text replaced by word; overlapping spans are one. All columns stay, n_chars follows the text.

    Null and empty texts stay as they are, very long ones are read whole, repeated rows stay, an empty table gives an
    empty result; no column's name is of consequence but that of the text and n_chars.
    """
    names, p = docs.columns, prefix(docs)
    d = with_parts(docs, text, p)
    t = f"coalesce({quoted(text)}, '')"
    # spans that overlap are one: it begins where no span before reaches, and ends where those before the next beginning do
    ends = _scan("transform(c, x -> x.e)", _MOST)
    begins = f"filter(zip_with(c, {ends}, (x, m) -> struct(x.s as s, m as m, x.s >= m as new)), x -> x.new)"
    joined = _bound(f"{p}spans", "c", _bound(begins, "g", "arrays_zip(transform(g, x -> x.s), concat(slice(transform(g, x -> x.m), 2, size(g)), array(array_max(transform(c, x -> x.e)))))"))
    joined = f"transform({joined}, x -> struct(x['0'] as s, x['1'] as e))"
    d = d.withColumn(f"{p}cut", F.expr(f"case when size({p}spans) > 0 then {joined} end"))
    # the text between the end of one span and the start of the next
    gaps = f"zip_with(concat(array(0), transform({p}cut, x -> x.e)), concat(transform({p}cut, x -> x.s), array(length({t}))), (a, b) -> struct(a, b))"
    few = f"transform({gaps}, x -> substring({t}, x.a + 1, x.b - x.a))"
    # substring looks for its place from the start of the text, so many gaps are cut from an array of its characters
    many = _bound(f"regexp_extract_all({t}, '(?s).', 0)", "c", f"transform({gaps}, x -> array_join(slice(c, x.a + 1, x.b - x.a), ''))")
    kept = f"if(size({p}cut) <= {FEW}, {few}, {many})"
    d = d.withColumn(text, F.expr(f"case when {p}cut is null then {quoted(text)} else array_join({kept}, '{word}') end"))
    if "n_chars" in names:
        d = d.withColumn("n_chars", F.expr(f"case when {p}cut is null then n_chars else cast(length({quoted(text)}) as bigint) end"))
    return d.select(*(column(c) for c in names))
