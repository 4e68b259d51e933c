"""Secret scanning with multipart credential linking.

Base spans are found by three fixed patterns, leftmost and non-overlapping for
each kind; a match that fails its length test is dropped after it has used up
its characters. Linking then adds what is too weak to report alone. The parts
of a credential are identifiers (access keys, or `client_id = ...` and the
like), secrets (base assignments and hex runs, or bare mixed-case keys) and
endpoints (URLs with a service scheme, cloud host names). Each part opens an
interval of `scope` characters on both sides, and parts of complementary roles
are joined where their intervals meet:

* a bare key is reported only with an identifier or an endpoint in scope,
* an identifier or an endpoint only with a secret in scope.

The join looks each interval up among the sorted starts and the sorted ends of
the complementary parts of its text, so its cost grows with the number of parts
and not with their pairs. Before any pattern runs, byte-level tests over
whole buffers set aside the texts that hold none of its needed substrings.

Every pattern takes time in proportion to a text's length, however its runs are
broken up: host names are found from their ends, and each run is walked once.

Nulls and odd input: a null text is empty and has no spans; positions are code
points, ends exclusive; repeated rows give repeated results; an empty table
gives an empty result; a text of any length is scanned whole; input columns named
`spans` are replaced and all others kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.shared import map_texts, others
from tessera.llm.text import LOWER, rows, spans_of

#: Kinds in the order in which spans of one start are listed; the first three are base kinds.
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
IDENT = re.compile(r"""(?ai)\b(?:client|user|account|access|app|application|tenant|project)[_-]?(?:key_?)?id["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{6,})""")
URL = re.compile(r"""(?ai)\b(?:https?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?|s3|ftps?|ssh)://[^\s"'<>]+""")
#: A host name is a run of letters, digits, dots and hyphens, from its first word boundary to its last such end.
HOST_END = re.compile(r"(?ai)\.(?:amazonaws\.com|windows\.net|googleapis\.com)\b")
HOST_START, HOST_RUN = re.compile(r"(?ai)\b[a-z0-9]"), re.compile(r"(?ai)[a-z0-9.-]*")
_HOST = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.-")
KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,128}={0,2}(?![A-Za-z0-9+/_=-])")
#: Lower-case bytes without which the pattern can't match.
NEEDS = {
    "assign": (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey"),
    "access": (b"akia",),
    "ident": (b"_id", b"-id", b"keyid", b"clientid", b"userid", b"accountid", b"accessid", b"appid", b"applicationid", b"tenantid", b"projectid"),
    "endpoint": (b"://", b".amazonaws.com", b".windows.net", b".googleapis.com"),
}
SCHEMA = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("links", T.IntegerType())]))
_HEX_BYTE = np.array([48 <= b <= 57 or 97 <= b <= 102 for b in range(256)])


def base_spans(text: str, kinds: set[str] = frozenset(KINDS)) -> list[tuple[str, int, int]]:
    found = []
    if "assign" in kinds:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "access" in kinds:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if "hex" in kinds:
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return found


def host_spans(text: str) -> Iterator[tuple[int, int]]:
    """Cloud host names, one at most in each run of their characters, of which each is looked at a few times only."""
    found = [(m.start(), m.end()) for m in HOST_END.finditer(text)]
    right = i = 0
    while i < len(found):
        left = found[i][0]
        while left > right and text[left - 1] in _HOST:
            left -= 1
        right = HOST_RUN.match(text, found[i][0]).end()
        while i + 1 < len(found) and found[i + 1][0] < right:
            i += 1
        first = HOST_START.search(text, left, found[i][0])
        if first:
            yield first.start(), found[i][1]
        i += 1


def endpoint_spans(text: str) -> list[tuple[int, int]]:
    """URLs and cloud host names, leftmost and without overlaps; a URL goes on to a space, quote or angle bracket, so it takes in the hosts that it meets."""
    out: list[tuple[int, int]] = []
    for a, b in sorted([*((m.start(), m.end()) for m in URL.finditer(text)), *host_spans(text)], key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def _counter(parts: list[tuple[str, int, int]], scope: int) -> Callable[[tuple[str, int, int]], int]:
    """Counts the parts whose spans come within the scope of another's: those that begin in time less those that have ended before."""
    starts, ends = sorted(p[1] for p in parts), sorted(p[2] for p in parts)
    return lambda p: bisect_right(starts, p[2] + scope) - bisect_left(ends, p[1] - scope)


def link(text: str, base: list[tuple[str, int, int]], kinds: set[str] = frozenset(KINDS), scope: int = 240) -> list[tuple[str, int, int, int]]:
    """Base spans and the weak parts that complementary parts confirm, each with its number of partners."""
    idents = [(k, a, b) for k, a, b in base if k == "access"]
    weak = [("ident", m.start(), m.end()) for m in IDENT.finditer(text)] if "ident" in kinds else []
    ends = [("endpoint", *span) for span in endpoint_spans(text)] if "endpoint" in kinds else []
    if not (idents or weak or ends):
        return [(*s, 0) for s in base]
    secrets = [(k, a, b) for k, a, b in base if k != "access"]
    taken = sorted((a, b) for _, a, b in base + weak + ends)
    reach = list(accumulate((b for _, b in taken), max))
    keys = []
    for m in KEY.finditer(text):
        mixed = re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0])
        i = bisect_left(taken, (m.end(), 0))
        if mixed and not (i and reach[i - 1] > m.start()):
            keys.append(("key", m.start(), m.end()))

    partners, owners = _counter(secrets + keys, scope), _counter(idents + weak + ends, scope)
    out = [(*s, owners(s) if s[0] != "access" else partners(s)) for s in base]
    out += [(*s, n) for s in weak + ends if (n := partners(s))]
    return out + [(*s, n) for s in keys if (n := owners(s))]


def _kernel(scope: int):
    def run(column: pa.Array) -> list[pa.Array]:
        data, at = rows(column)
        low = data.tobytes().translate(LOWER)
        kinds: dict[int, set[str]] = {}
        for kind, needles in NEEDS.items():
            for needle in needles:
                p = low.find(needle)
                while p >= 0:
                    d = int(np.searchsorted(at, p, "right")) - 1
                    kinds.setdefault(d, set()).add(kind)
                    p = low.find(needle, at[d + 1])  # once is enough for a text
        a, b = spans_of(_HEX_BYTE[data])
        long = b - a >= 16
        first, last = (np.searchsorted(at, x[long], "right") - 1 for x in (a, b - 1))
        for lo, hi in zip(first.tolist(), last.tolist(), strict=True):
            for d in range(lo, hi + 1):  # a run may go on into the texts that follow
                kinds.setdefault(d, set()).add("hex")
        out = [[] for _ in range(len(at) - 1)]
        for d, some in kinds.items():
            text = data[at[d] : at[d + 1]].tobytes().decode("utf-8", "replace")
            found = link(text, base_spans(text, some), some, scope)
            found.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
            out[d] = [{"kind": k, "start": x, "end": y, "links": n} for k, x, y, n in found]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("links", pa.int32())]))
        return [pa.array(out, kind)]

    return run


def find_secrets(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, scope: int = 240) -> DataFrame:
    """Each row of docs with spans: array of (kind, start, end, links), links counting complementary parts in scope."""
    keep = others(docs.select(*keep) if keep else docs, ["spans"])
    return map_texts(docs, text, keep, [T.StructField("spans", SCHEMA)], lambda: _kernel(scope))
