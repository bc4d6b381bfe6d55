"""Secret scan: patterns, and dictionary-primed zstandard novelty.

Base patterns find assignments, access keys and hex strings.  The method adds
strings that no pattern names: a *candidate* is a run of 16 or more characters
``[A-Za-z0-9+/_.=-]`` in a sensitive place, outside the base spans.  Sensitive are
a line with a sensitive word, the next line with text if such a line ends with the
word (and a colon or the like), and the lines of a private key block.  Next to
an @, mail names and host names are left out; a URL's password is not.
Its novelty is the number of bytes that it adds to a zstandard frame whose raw
dictionary holds common identifiers, the words that stand in it and also elsewhere in the text, and the text around
it (``AROUND`` characters to each side).  Time is linear in the text.  Words, paths and identifiers are in the dictionary or
compress; a random string does not: candidates are reported if they add at least ``NOVELTY`` of what a random string of their length
and alphabet (digits, hex, base32, ... base64) adds without surroundings.

Defined results: null is taken as the empty text, which has no span.  Spans count
code points, end exclusive; a text of any length is scanned whole.  Base spans of
different kinds may overlap; added ones overlap none.  Rows may repeat.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "novel"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is the same run as one of one or more
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_SENSITIVE = re.compile(r"pass(?:word|wd|phrase)|secret|token|api_?key|credential|private[_ -]?key|access[_ -]?key|bearer|authorization", re.I | re.A)
_RUN = re.compile(r"(?:[\w.-]*\w)?", re.A)
_OPENERS = ":=>|\\[({"
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*+)-----")
_EDGE = re.compile(r"-----(?:BEGIN|END)")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?![A-Za-z0-9+_=.-])/*")
_WORD = re.compile(r"[A-Za-z]{4,}")
_BLANKS = re.compile(r"\s*")
_NAME = re.compile(r"[A-Za-z_.-]+=(?=[^=])")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
AROUND, NOVELTY = 512, 0.8
SHORT, LONG = 4, 24  # letters of the words looked for inside a candidate
_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A candidate's alphabet is the first that has all its characters.
ALPHABETS = [_DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _UPPER + "234567=", _UPPER.lower() + "234567=", _DIGITS + _UPPER, _DIGITS + _UPPER.lower(),
             _DIGITS + _UPPER + _UPPER.lower(), _DIGITS + _UPPER + _UPPER.lower() + "+/_.=-"]
IDENTIFIERS = " ".join("""
abstract access account action address admin algorithm alias allow append application archive argument array assert assign async
attribute authorization auth backend base batch binary block body boolean boot bucket buffer build bytes cache callback catch
certificate channel char class client close cluster code collection column command comment commit common compile component config
configuration connect connection console const constant constructor container content context controller convert cookie copy core
count create credentials cursor data database date debug decode default define delete deploy description development device dict
digest directory disable document domain double download driver element email enable encode encoding encrypt endpoint engine entity
entry enum environment error event example exception execute expire export extend extension factory false fetch field file filter
final finally find first flag float folder force format frame function generate global graph group handle handler hash header height
hidden hook host http https identifier image implement import include index info init inline input insert instance integer interface
internal invalid item iterator java javascript json key keyword label lambda language last layer layout length level library license
line link list listen load local localhost lock log logger login loop main manager map match maximum member memory merge message
meta method metric middleware minimum mode model module monitor mount name namespace network next node null number object offset
open operation operator option order organization output override package page panel parameter parent parse partition password patch
path pattern payload permission plugin point policy pool port position prefix print private process production profile project
property protected protocol provider proxy public publish query queue random range rate read record redirect reference refresh region
register release remote remove render repository request require reset resource response result return role root route router row
rule runtime sample save schema scope script search secret section secure select self sequence server service session setting setup
shard shell signature size sleep socket sort source space split stack staging start state static status stop storage store stream
string struct style submit subscribe success suffix super switch symbol sync system table tag target task template tenant test text
thread throw time timeout timestamp title token trace transaction transform true type undefined unique unit update upload user
username utils uuid valid validate value variable vector version view virtual visible void wait warning width window worker workspace
wrapper write yaml zone
""".split()).encode()


def base_spans(text: str, lowered: str | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, in order."""
    out = []
    lowered = text.lower() if lowered is None else lowered
    if any(w in lowered for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def marginal_bytes(candidate: str, around: str, words: str = "") -> int:
    """Bytes that ``candidate`` adds to an empty frame, given identifiers, words and surrounding text as dictionary."""
    primed = zstandard.ZstdCompressionDict(words.encode() + IDENTIFIERS + b" " + around.encode("utf-8", "ignore"),
                                           dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=6, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
    return len(press.compress(candidate.encode())) - len(press.compress(b""))


@lru_cache(maxsize=4096)
def _random_bytes(alphabet: int, length: int) -> int:
    return marginal_bytes("".join(random.Random(length).choices(ALPHABETS[alphabet].rstrip("="), k=length)), "")


def random_bytes(candidate: str) -> int:
    """Bytes that a random string of the candidate's length and alphabet adds."""
    letters = set(candidate)
    return _random_bytes(next(i for i, a in enumerate(ALPHABETS) if letters <= set(a)), len(candidate))


class _Taken:
    """Do any of the spans overlap a stretch?"""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts, self.ends = [], []
        for s, _, e in spans:
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def overlaps(self, first: int, last: int) -> bool:
        at = bisect_left(self.starts, last)
        return at > 0 and self.ends[at - 1] > first


def known_words(run: str, words: Counter) -> str:
    """Words that stand in ``run`` and also elsewhere in the text whose words are counted in ``words``."""
    runs = _WORD.findall(run.lower())
    own, known = Counter(runs), {}
    for r in runs:
        if words[r] > own[r]:
            known[r] = None
        for i in range(len(r) - SHORT + 1):
            for k in range(i + SHORT, min(i + LONG, len(r)) + 1):
                part = r[i:k]
                if part in words and words[part] > own[part]:
                    known[part] = None
    return "".join(w + " " for w in known)


def novel_spans(text: str, taken: list[tuple[int, int, int]], lowered: str, novelty: float = NOVELTY) -> list[tuple[int, int, int]]:
    """(start, 3, end) of incompressible strings in sensitive places, outside ``taken``."""
    out, words, base = [], None, _Taken(taken)
    for first, last in sensitive_places(text):
        for m in _CANDIDATE.finditer(text, first, last):
            s, e = m.span()
            if text[e : e + 1] == "@":
                if text[s : s + 2] == "//":
                    s += 2  # a URL's user
                elif text[max(0, s - 1) : s] != ":":
                    continue  # a mail name
            elif text[max(0, s - 1) : s] == "@" and (host := _HOST.match(text, s, e)):
                s = host.end()
            if name := _NAME.match(text, s, e):
                s = name.end()
            if e - s < 16 or base.overlaps(s, e):
                continue
            run = text[s:e]
            if not any(c.isdigit() for c in run):
                run = run.lower()  # names in any case are known
            if words is None:
                words = Counter(_WORD.findall(lowered))
            around = text[max(0, s - AROUND) : s] + " " + text[e : e + AROUND]
            if marginal_bytes(run, around, known_words(run, words)) >= novelty * random_bytes(run):
                out.append((s, 3, e))
    return out


def _ends_line(text: str, word_end: int, line_end: int) -> bool:
    """Is the line over after a sensitive word, but for the rest of its name, a quote, a colon or the like and another quote?"""
    def blanks(at: int) -> int:
        while at > word_end and text[at - 1].isspace():
            at -= 1
        return at

    at = blanks(line_end)
    if at > word_end and text[at - 1] in "\"'":
        at = blanks(at - 1)
    while at > word_end and text[at - 1] in _OPENERS:
        at -= 1
    at = blanks(at)
    if at > word_end and text[at - 1] in "\"'":
        at -= 1
    return _RUN.fullmatch(text, word_end, at) is not None


def sensitive_places(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sensitive lines, in order, each place once."""
    found, line_end, last = [], -1, 0

    def close() -> None:
        if line_end >= 0 and _ends_line(text, last, line_end):
            found.append(_next_line(text, line_end))

    for word in _SENSITIVE.finditer(text):
        if word.start() >= line_end:
            close()  # the line before: its last word is the one that can end it
            line_end = text.find("\n", word.end())
            line_end = len(text) if line_end < 0 else line_end
            found.append((text.rfind("\n", 0, word.start()) + 1, line_end))
        last = word.end()
    close()
    if "PRIVATE KEY" in text:
        edges = [m.start() for m in _EDGE.finditer(text)]
        for m in _BEGIN.finditer(text):
            _, mark, rest = m.group(1).rpartition("PRIVATE KEY")
            if mark and not any(c.isdigit() for c in rest):
                at = bisect_left(edges, m.end())
                found.append((m.end(), edges[at] if at < len(edges) else len(text)))
    out = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _next_line(text: str, at: int) -> tuple[int, int]:
    """The next line with text after the line that ends at ``at``."""
    first = _BLANKS.match(text, at).end()
    end = text.find("\n", first)
    return first, len(text) if end < 0 else end


def scan_text(text: str | None) -> list[tuple[int, int, int]]:
    """All spans (start, kind, end) of a text, by start, then kind."""
    text = text or ""
    lowered = text.lower()
    base = base_spans(text, lowered)
    return sorted(base + novel_spans(text, base, lowered))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans) per row of ``docs``."""
    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                found = [scan_text(t.as_py()) for t in part.column(1)]
                counts = [pa.array([sum(1 for x in f if x[1] == kind) for f in found], pa.int64()) for kind in range(4)]
                digest = [hashlib.sha256(_joined([x for x in f if x[1] < 3]).encode()).hexdigest() for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, pa.array(digest, pa.string()), pa.array([_joined(f) for f in found], pa.string())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return (docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
            .mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, "
                             "base_sha256 string, spans string"))
