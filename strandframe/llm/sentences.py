"""Sentence units for every document, in all its languages and scripts.

The boundary rules are compiled into two transducers, one feeding the other. A scan over the text
finds the places where something can happen (stops, quotation marks, blank lines, white space
between Thai letters). For a stop, the first machine, made from the table ``RULES``, reads the
classes of its kind, the marks that close after it, the gap, what follows and what stands before,
as far as its state still depends on them, and writes a symbol; the other places give their symbol by
one look. The second machine reads the symbols; its state is the depth of open quotations.
A symbol moves the state and may end a unit.

Documents are cut into chunks, long ones into many. A symbol's effect on the depth is a function
``max(depth + a, b)``; such functions compose to one of the same kind, so each chunk's is two
numbers, whatever the depth. A prefix scan composes the functions of a document's chunks, each
chunk learns the depth it begins in and emits its boundaries. Chunks are independent rows, so
one huge document keeps many tasks busy. A cut lies where no rule looks across it further than
the margin a chunk carries, so the units do not depend on where the cuts are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.session import written

CHUNK = 32_768
#: Context on both sides of a chunk, in code points: more than the rules' look-around over shorter runs than ``RUN``.
MARGIN = 2_048
#: Runs of white space, stops and closing marks from this length on are never within the margin of a cut.
RUN = 256
#: A function that forgets the depth it is given.
FORGET = -(10**9)

# Abbreviations that do not end a sentence, whatever follows.
NEVER = frozenset(
    "dr mr mrs ms prof st cf vgl zzgl bzw ca ets mm mme mlle sr sra dra v vs wst approx ggf inkl sog az hon messrs "
    "г проф см им тов डॉ नं श्री د أ".split()
)
# Abbreviations with inner stops that do not end a sentence, whatever follows.
NEVER_DOTTED = frozenset("i.e e.g u.l.r z.b d.h т.е".split())
# Abbreviations that do not end a sentence before a figure.
BEFORE_FIGURE = frozenset(
    "no nos nr art arts para paras s ss p pp vol exh fig sec cl ch abs bl rn rdnr ziff kap al n núm pág págs párr cap arg rep u.l.r "
    "ст п пп стр л д гл ص م ف पृ".split()
)
# Abbreviations that may also be the last word of a sentence.
MAY_END = frozenset("ltd co inc corp llc etc usw env руб коп млн cent jr p.m a.m".split())
# Ends of company names, which stand inside sentences of scripts without capitals.
COMPANY = frozenset("ltd co inc corp llc".split())
# German words before an ordinal.
BEFORE_ORDINAL = frozenset("am im vom zum zur der des dem den die das und bis beim ab seit".split())
# Characters that follow a closed quotation inside the same sentence.
GOES_ON = frozenset("とがはをにでものや、，；：,;:的")

_LISTED = {w: name for name, words in (("may end", MAY_END), ("company", COMPANY), ("figure", BEFORE_FIGURE), ("never", NEVER | NEVER_DOTTED)) for w in words}

_THAI = "ก-ฺเ-๎"
_UPPER = "A-ZÀ-ÖØ-ÞА-Я"
_LOWER = "a-zß-öø-ÿа-яё"


def _scanner(also: str) -> re.Pattern:
    """One pattern for all places of interest: a character to look for, then what it turns out to be."""
    return re.compile(
        rf"[\n.。！？…!?؟।\"„“”«»「」『』█)\]*{also}]"
        r"(?:(?<=\n)(?P<blank>[^\S\n]*\n\s*)"
        # A long lower-case word, a stop and a capital; the words in the way are abbreviations.
        rf"|(?<=[{_LOWER}][{_LOWER}][{_LOWER}][{_LOWER}]\.)(?<!zzgl\.)(?<!inkl\.)(?<!prox\.)(?<!ssrs\.)(?<!проф\.)(?P<sure>)(?=\s+[{_UPPER}])"
        r"|(?<=[。！？])[。！？]*(?P<ccl>[”』」）)]*)"
        rf"|(?<=[.…!?؟।])(?!(?<=\.)(?:[0-9]|\s?[{_LOWER}]))(?P<cl>[.…!?؟।]*(?:[ \u00a0\u202f\n]?»|[\"”“’)\]])*)"
        r"|(?<=[\"„“”«»「」『』])(?P<quote>)"
        rf"|(?<=[{_THAI}]\s)(?P<thai>\s*)(?=[{_THAI}])"
        rf"|(?:(?<=█)|(?<=\(…\))|(?<=\[REDACTED\])|(?<=\[name withheld\])|(?<=X\*\*\*))(?P<cut>)(?=\s+[{_UPPER}]\w))"
    )


_EVENT, _EVENT_THAI = _scanner(""), _scanner(r"\s")
_HAS_THAI = re.compile(f"[{_THAI}]")
_STOPS = re.compile("[.…!?؟।]+")
_BEFORE_CJK = re.compile(r"[^\u2e80-\uffef]*$")
_OPENERS = "([{\"'«„“‘¿¡§$€-–—"
_QUOTES_CLOSED = re.compile("[\"”“»』」]")
_SPACE = re.compile(r"\s*")
_REDACTED = re.compile(r"(?:█+|\(…\)|\[REDACTED\]|\[name withheld\]|X\*\*\*)$")
_CUT_AFTER = re.compile(rf"\s+[{_UPPER}]\w")
_MARK_BEFORE = re.compile(r"(?:^|\n\s*\n\s*)\s*(?:§\s*)?\d+$")
_HEADER = re.compile(r"[^\n]{0,100}\b[A-Z]{1,4}-\d+/\d+\b[^\n]{0,40}\d[^\n]{0,3}(?=\s*(?:\n[^\S\n]*\n|$))")
_LONE_HEADER = re.compile(r"(?:^|\n\s*\n)\s*([^\n]+)$")

#: Symbols: the function (a, b) of a step, depth -> max(depth + a, b), and the depth up to which it ends a unit.
STEP = {"S": ((0, 0), 0), "T": ((0, 0), 0), "O": ((1, 0), -1), "C": ((-1, 0), -1), "E": ((-1, 0), 1), "B": ((FORGET, 0), 10**9), "H": ((0, 0), 10**9)}
_LONG_RUN = re.compile(rf"[\s.…!?؟।。！？\"“”»’)\]』」）█*]{{{RUN},}}")


def _word(before: str) -> tuple[str, str]:
    """The word that ends a piece of text ("" if none does) and the word before it."""
    words = before.split()
    if not words or before[-1].isspace():
        return "", ""
    word = words[-1]
    if not word.isascii():
        word = _BEFORE_CJK.search(word).group() or word
    word = word.lstrip(_OPENERS).replace("’", "'").rpartition("'")[2]
    last = word[-1:]
    if not (last.isalnum() or unicodedata.combining(last or " ") or unicodedata.category(last or " ") in ("Mc", "Mn")):
        word = ""
    return word, words[-2] if len(words) > 1 else ""


def _before(text: str, at: int) -> str:
    """The class of what stands before a full stop."""
    before = text[max(0, at - 40) : at]
    if before.endswith("/"):
        return "slash"
    word, lead = _word(before)
    if not word:
        return "closed" if before and before[-1] in ")]%»”" else "bare"
    lone = "lone " if len(word) == 1 else ""
    if word.isdigit():
        if _MARK_BEFORE.search(text[max(0, at - 60) : at]):
            return lone + "mark"
        if len(word) <= 2 and lead.lower() in BEFORE_ORDINAL:
            return lone + "ordinal"
        return "open" if lone else "word"
    if lone and ord(word) < 0x590 and word.isalpha():
        # Initials and one-letter abbreviations, but for the end of a two-letter one (d. A.).
        return "last" if word == "A" and lead in ("d.", "S.") else "never"
    return _LISTED.get(word.lower()) or ("open" if lone or "." in word else "word")


@cache
def _char(c: str) -> str:
    """The class of a character that follows a stop."""
    if not c:
        return "end"
    if c.islower() or c in ",;:.)":
        return "joined"
    if c in "/&":
        return "linked"
    if c in "([":
        return c
    far = "far " if ord(c) > 0x590 else ""
    if c.isdigit():
        return far + "digit"
    if c.isupper():
        return far + ("upper" if c.isalpha() else "sign")
    if c.isalpha():
        return far + "letter"
    if c in "\"«„“¿¡█":
        return far + "opening"
    return far + ("section" if c == "§" else "other")


def _follow(text: str, end: int) -> tuple[str, str]:
    """Whether white space follows, and the class of the first character after it."""
    gap, c = "close", text[end : end + 1]
    if c.isspace():
        gap, end = "gap", _SPACE.match(text, end).end()
        c = text[end : end + 1]
    if c == "[" and text[end + 1 : end + 2].isdigit():
        return gap, "cite"
    if c == "(" and text[end + 1 : end + 2] == "…":
        return gap, "redaction"
    return gap, _char(c)


# What a stop's tape is written in, in reading order.
KINDS = ("full stop", "ellipsis", "question", "danda", "ideographic")
CLOSERS = ("none", "some", "quote")
GAPS = ("gap", "close")
FOLLOWS = (
    "end", "joined", "linked", "(", "[", "cite", "redaction", "digit", "upper", "letter", "opening", "section", "other",
    "far digit", "far upper", "far sign", "far letter", "far opening", "far other", "goes on", "stop",
)
WORDS = ("slash", "closed", "bare", "mark", "lone mark", "ordinal", "lone ordinal", "never", "figure", "company", "may end", "last", "open", "word")

_DIGITS, _CAPITALS, _OPENING = {"digit", "far digit"}, {"upper", "far upper", "far sign"}, {"opening", "far opening", "(", "[", "cite", "redaction"}
_LETTERS, _FAR = {"upper", "letter", "far upper", "far letter"}, {f for f in FOLLOWS if f.startswith("far ")}
_MARKS, _ORDINALS = {"mark", "lone mark"}, {"ordinal", "lone ordinal"}

#: The rules for stops: kind, closers, gap, what follows, what stands before (None: anything), and whether a sentence ends. The first that fits holds.
RULES = [
    ({"ideographic"}, {"quote"}, None, {"goes on"}, None, False),
    ({"ideographic"}, {"some"}, None, {"goes on", "stop"}, None, False),
    ({"ideographic", "danda"}, None, None, None, None, True),
    (None, None, None, {"end"}, None, True),
    (None, None, None, {"joined"}, None, False),
    ({"question"}, None, {"gap"}, None, None, True),
    ({"question"}, None, {"close"}, _CAPITALS | _FAR, None, True),
    ({"question"}, None, None, None, None, False),
    ({"ellipsis"}, None, {"gap"}, _CAPITALS, None, True),
    ({"ellipsis"}, {"some", "quote"}, {"gap"}, None, None, True),
    ({"ellipsis"}, None, None, None, None, False),
    # Full stops from here on.
    (None, None, None, {"linked"}, None, False),
    (None, None, None, None, {"slash"}, False),
    # Nothing between the stop and what follows.
    (None, None, {"close"}, _OPENING, None, True),
    (None, None, {"close"}, _LETTERS, {"closed"}, True),
    (None, None, {"close"}, None, {"bare", "lone mark", "lone ordinal", "never", "figure", "last", "open"}, False),
    (None, None, {"close"}, _FAR, {"company"}, False),
    (None, None, {"close"}, _LETTERS - {"letter"}, None, True),
    (None, None, {"close"}, None, None, False),
    # White space after the stop.
    (None, None, None, None, _MARKS | {"never"}, False),
    (None, None, None, _CAPITALS, _ORDINALS, False),
    (None, None, None, _DIGITS | {"[", "cite", "section"}, {"figure"}, False),
    (None, None, None, _FAR, {"company"}, False),
    # A year or a reference in brackets goes on, a redaction in brackets is the next sentence's first word.
    (None, None, None, {"(", "cite"}, {"company", "may end"}, False),
    (None, None, None, _DIGITS, {"last"}, False),
    (None, None, None, None, None, True),
]
#: What the machine writes at the end of its tape, which is what the machine over quotation depth reads.
OUTPUT = {("quote", True): "E", ("quote", False): "C", ("some", True): "S", ("some", False): "", ("none", True): "S", ("none", False): ""}


def compiled(rules: list[tuple]) -> dict[tuple[str, str], dict | str]:
    """The rules as a machine: per kind and closers a state, which is a dict of moves or, where nothing more need be read, the symbol to write.

    Equal states are one, and a state all of whose moves lead to one place is that place.
    """
    states: dict[tuple, dict] = {}

    def state(left: list[tuple], level: int, closers: str) -> dict | str:
        if level == 5:
            return OUTPUT[closers, left[0][5]]
        moves = {}
        for symbol in (KINDS, CLOSERS, GAPS, FOLLOWS, WORDS)[level]:
            moves[symbol] = state([r for r in left if r[level] is None or symbol in r[level]], level + 1, closers)
        first = next(iter(moves.values()))
        if level != 2 and all(m is first or m == first for m in moves.values()):
            return first
        return states.setdefault(tuple(m if isinstance(m, str) else id(m) for m in moves.values()), moves)

    start = {}
    for kind in KINDS:
        for closers in CLOSERS:
            left = [r for r in rules if (r[0] is None or kind in r[0]) and (r[1] is None or closers in r[1])]
            start[kind, closers] = state(left, 2, closers)
    return start


MACHINE = compiled(RULES)


def _quote(text: str, start: int, end: int) -> str:
    """O or C for a quotation mark, by its neighbours where the mark itself does not tell."""
    mark = text[start:end]
    if mark in "«„「『":
        return "O"
    if mark in "»」』”":
        return "C"
    before, after = text[start - 1 : start], text[end : end + 1]
    if not after or after.isspace():
        return "C"
    if mark == "“":
        return "C" if after in ".,;:!?)" else "O"
    return "O" if not before or before.isspace() or before in "([«„“-–—:/" or ord(before) > 0x2E80 else "C"


def _closers(closers: str) -> str:
    return "none" if not closers else "quote" if _QUOTES_CLOSED.search(closers) else "some"


def _ideographic(text: str, closers: str, end: int) -> str:
    """The symbol of an ideographic stop: only the very next character counts."""
    follow = text[end : end + 1]
    kind = "end" if not follow else "goes on" if follow in GOES_ON else "stop" if follow in "。！？" else "other"
    state = MACHINE["ideographic", _closers(closers)]["close"]
    return state if isinstance(state, str) else state[kind]


def _stop(text: str, stop: str, closers: str, start: int, end: int) -> str:
    """The symbol the machine writes for a stop ("" for none); the word before it is read only in states that depend on it."""
    if stop == "." or stop == ".." or (stop[0] == "." and stop[-1] != "."):
        kind = "full stop"
    else:
        kind = "danda" if stop[0] == "।" else "ellipsis" if stop[0] in ".…" else "question"
    gap, follow = _follow(text, end)
    state = MACHINE[kind, _closers(closers)][gap]
    if not isinstance(state, str):
        state = state[follow]
    return state if isinstance(state, str) else state[_before(text, start + len(stop) - 1)]


def _blank(text: str, start: int, end: int) -> str:
    """H where a page header stands on either side of a blank line inside a sentence, else B."""
    if _HEADER.match(text, end):
        return "B" if text[start - 1 : start] in tuple(".!?。！？।؟") else "H"
    lone = _LONE_HEADER.search(text, max(0, start - 200), start)
    return "H" if lone and _HEADER.match(text, lone.start(1)) else "B"


def _hides_a_stop(text: str, end: int) -> bool:
    """Whether a redaction before a capital took a name with its full stop: not after an article or preposition."""
    near = text[max(0, end - 60) : end]
    found = _REDACTED.search(near)
    return bool(found) and _word(near[: found.start()].rstrip())[0].lower() not in BEFORE_ORDINAL


def events(text: str) -> list[tuple[str, int, int, int]]:
    """What can happen in a text: (symbol, place, end of the unit, where the next may begin)."""
    out: list[tuple[str, int, int, int]] = []
    for m in (_EVENT_THAI if _HAS_THAI.search(text) else _EVENT).finditer(text):
        kind = m.lastgroup
        start, end = m.span()
        if kind == "sure":
            out.append(("S", start, end, end))
        elif kind == "cl":
            stop = _STOPS.match(text, start).group()
            if stop[0] == "…" and text[start - 1 : start] == "(" and text[start + 1 : start + 2] == ")":
                # A redaction, not an ellipsis; what follows its bracket is looked at on its own.
                if _CUT_AFTER.match(text, end) and _hides_a_stop(text, end):
                    out.append(("S", start, end, end))
                continue
            symbol = _stop(text, stop, text[start + len(stop) : end], start, end)
            if symbol:
                out.append((symbol, start, end, end))
        elif kind == "quote":
            out.append((_quote(text, start, end), start, end, end))
        elif kind == "ccl":
            symbol = _ideographic(text, m.group("ccl"), end)
            if symbol:
                out.append((symbol, start, end, end))
        elif kind == "blank":
            out.append((_blank(text, start, end), start, start, end))
        elif kind == "thai":
            out.append(("T", start, start, end))
        elif _hides_a_stop(text, end):
            out.append(("S", start, end, end))
    return out


def transition(symbols: str) -> tuple[int, int]:
    """The function (a, b) of a run of symbols: depth -> max(depth + a, b)."""
    a, b = 0, 0
    for symbol in symbols:
        (c, d), _ = STEP[symbol]
        a, b = max(a + c, FORGET), max(b + c, d)
    return a, b


def _trimmed(text: str, end: int, start: int) -> tuple[int, int]:
    """The cut without the white space on both sides."""
    while end and text[end - 1].isspace():
        end -= 1
    return end, _SPACE.match(text, start).end()


def boundaries(symbols: str, depth: int) -> list[int]:
    """Which symbols end a unit if the first one is met at this depth."""
    out = []
    for k, symbol in enumerate(symbols):
        (a, b), most = STEP[symbol]
        if depth <= most:
            out.append(k)
        depth = max(depth + a, b)
    return out


def joined(begin: int | None, ends: list[int], nexts: list[int]) -> tuple[list[int], list[int], int | None]:
    """Starts and ends of the units between boundaries, and where the next one begins; a boundary before any text moves the begin."""
    starts, stops = [], []
    for end, start in zip(ends, nexts):
        if begin is None or end > begin:
            starts.append(begin)
            stops.append(end)
            begin = start
        else:
            begin = max(begin, start)
    return starts, stops, begin


def units(text: str) -> list[tuple[int, int]]:
    """All units of a text as (start, end) code points, trimmed of white space."""
    found = events(text)
    edges = [_trimmed(text, found[k][2], found[k][3]) for k in boundaries("".join(e[0] for e in found), 0)]
    starts, ends, begin = joined(_SPACE.match(text).end(), [a for a, _ in edges], [b for _, b in edges])
    last = len(text.rstrip())
    return [*zip(starts, ends), *([(begin, last)] if last > begin else [])]


def cuts(text: str, chunk: int) -> list[int]:
    """Where chunks begin: at every ``chunk`` code points, moved on past places too near to a long run."""
    if len(text) <= chunk:
        return [0]
    near = [(m.start() - MARGIN, m.end() + MARGIN) for m in _LONG_RUN.finditer(text)]
    out, at, k = [0], chunk, 0
    while at < len(text):
        while k < len(near) and near[k][1] <= at:
            k += 1
        if k < len(near) and near[k][0] < at:
            at = near[k][1]
            continue
        out.append(at)
        at += chunk
    return out


def compose(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of depth functions (n, 2) by doubling: row i holds f_i ∘ … ∘ f_0."""
    scan, step = functions.copy(), 1
    while step < len(scan):
        a, b = scan[:-step, 0], scan[:-step, 1]
        c, d = scan[step:, 0], scan[step:, 1]
        scan[step:] = np.stack([np.maximum(a + c, FORGET), np.maximum(b + c, d)], axis=1)
        step *= 2
    return scan


_CHUNK = "doc_id bigint, chunk_no int, base bigint, low bigint, high bigint, text string"


def _cut(chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every chunk with its margins; a document is walked through once."""
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                starts = cuts(text, chunk)
                for no, (low, high) in enumerate(zip(starts, [*starts[1:], len(text)])):
                    base = max(0, low - MARGIN)
                    rows.append((doc_id, no, base, low, high, text[base : high + MARGIN]))
                    if len(rows) >= 64:
                        yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "base", "low", "high", "text"])
                        rows = []
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "base", "low", "high", "text"])

    return run


def _short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Units of documents that are one chunk, which begins at depth 0."""
    for batch in batches:
        ids, starts, ends = [], [], []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            for start, end in units(text):
                ids.append(doc_id)
                starts.append(start)
                ends.append(end)
        yield pd.DataFrame({"doc_id": np.array(ids, "int64"), "sent_start": np.array(starts, "int64"), "sent_end": np.array(ends, "int64")})


_SCANNED = "doc_id bigint, chunk_no int, a bigint, b bigint, symbols string, ends array<bigint>, nexts array<bigint>, first bigint, last bigint"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A chunk's symbols, their function, and the boundaries they may be; where its text begins and ends."""
    for batch in batches:
        rows = []
        for row in batch.itertuples():
            text, base = row.text, row.base
            found = [e for e in events(text) if row.low <= base + e[1] < row.high]
            symbols = "".join(e[0] for e in found)
            edges = [_trimmed(text, e[2], e[3]) for e in found]
            own = text[row.low - base : row.high - base]
            blank = not own or own.isspace()
            first = None if blank else row.low + _SPACE.match(own).end()
            last = None if blank else row.low + len(own.rstrip())
            rows.append((row.doc_id, row.chunk_no, *transition(symbols), symbols, [base + a for a, _ in edges], [base + b for _, b in edges], first, last))
        yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "a", "b", "symbols", "ends", "nexts", "first", "last"]).astype({"first": "Int64", "last": "Int64"})


def _depths(functions: pd.DataFrame) -> pd.DataFrame:
    """The depth each chunk of one document begins in, from a scan over the chunks' functions: two numbers each."""
    functions = functions.sort_values("chunk_no")
    scan = compose(functions[["a", "b"]].to_numpy(dtype=np.int64))
    after = np.maximum(scan[:, 0], scan[:, 1])
    return pd.DataFrame({"doc_id": functions["doc_id"], "chunk_no": functions["chunk_no"], "depth": np.concatenate([[0], after[:-1]])})


_EMITTED = "doc_id bigint, chunk_no int, sent_start array<bigint>, sent_end array<bigint>, begin bigint"


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Units of chunks whose depth is known; the first one's start (null) lies in an earlier chunk, ``begin`` is where the last one is left open."""
    for batch in batches:
        rows = []
        for row in batch.itertuples():
            kept = boundaries(row.symbols, row.depth)
            starts, ends, begin = joined(None, [row.ends[k] for k in kept], [row.nexts[k] for k in kept])
            rows.append((row.doc_id, row.chunk_no, starts, ends, begin))
        yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "sent_start", "sent_end", "begin"]).astype({"begin": "Int64"})


def sentence_units(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, sent_start, sent_end of every unit; positions are code points, the end exclusive.

    Null and empty texts, texts of white space alone and rows without an id have no units. The id must be
    unique; other columns are ignored. Depth of quotation has no limit. ``chunk`` says how
    documents are spread over tasks and has no part in the result.
    """
    docs = documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    short = docs.where(F.length("text") <= chunk).mapInPandas(_short, "doc_id bigint, sent_start bigint, sent_end bigint")

    pieces = docs.where(F.length("text") > chunk).mapInPandas(_cut(chunk), _CHUNK).repartition("doc_id", "chunk_no")
    found = written(pieces.mapInPandas(_scan, _SCANNED))
    depths = found.select("doc_id", "chunk_no", "a", "b").groupBy("doc_id").applyInPandas(_depths, "doc_id bigint, chunk_no int, depth bigint")
    emitted = written(found.join(depths, ["doc_id", "chunk_no"]).select("doc_id", "chunk_no", "symbols", "ends", "nexts", "depth").mapInPandas(_emit, _EMITTED))
    # What passes from chunk to chunk is small: where the open unit begins. Only that is put in a document's order.
    edges = emitted.select("doc_id", "chunk_no", "begin").join(found.select("doc_id", "chunk_no", "first", "last"), ["doc_id", "chunk_no"])
    order = Window.partitionBy("doc_id").orderBy("chunk_no")
    before, all_of = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("doc_id")
    carried = edges.select(
        "doc_id", "chunk_no", F.coalesce(F.last("begin", ignorenulls=True).over(before), F.min("first").over(all_of)).alias("carry"),
        F.last("begin", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("open"), F.min("first").over(all_of).alias("head"), F.max("last").over(all_of).alias("tail"),
    )
    spans = emitted.join(carried.select("doc_id", "chunk_no", "carry"), ["doc_id", "chunk_no"]).select(
        "doc_id", "carry", F.explode(F.arrays_zip("sent_start", "sent_end")).alias("u")
    ).select("doc_id", F.coalesce("u.sent_start", "carry").alias("sent_start"), F.col("u.sent_end").alias("sent_end"))
    rest = carried.where("chunk_no = 0").select("doc_id", F.coalesce("open", "head").alias("sent_start"), F.col("tail").alias("sent_end"))
    return short.unionByName(spans.unionByName(rest).where(F.col("sent_end") > F.col("sent_start")))
