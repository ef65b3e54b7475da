"""Personal data: a semi-Markov conditional random field over whole candidate spans.

Four base kinds are exact patterns (email, ip, card, phone); their spans always stay.  The model adds
spans of further kinds that patterns with fixed rules miss: ``handle`` (an address written out, "ann
at mail dot com"), ``number`` (a card or phone number that is spaced or marked otherwise) and
``secret`` (keys and tokens).  Only zones around digits, '@' and trigger words are decoded; within a
zone all candidate segments of at most ``MAX_TOKENS`` tokens compete, each scored by features of the
whole span and its kind, and dynamic programming chooses boundaries and kinds together over the
whole zone, with as many entities as there are.  The weights are trained here, by
gradient ascent on the semi-Markov likelihood over generated examples with known spans.

Edge cases: null and empty texts have no spans; a very long text is decoded in linear
time, with features of ``WINDOW`` tokens in memory at once; rows that repeat are each decoded alike; an empty table gives no rows; a null doc_id is
kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, slices, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("handle", "number", "secret")
KINDS = (*BASE, *ADDED)
#: Tokens of an entity at most; candidates that begin in a window are scored at once; tokens before a span that features look at.
MAX_TOKENS, WINDOW, CONTEXT = 9, 48, 4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of ``local@domain`` found from the '@', so a long run of letters costs nothing."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    runs = _DIGITS.findall(text)
    if len(runs) >= 4 and text.count(".") >= 3:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                out.append(("ip", m.start(), m.end()))
    if sum(map(len, runs)) >= 16:
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if runs and "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# ---- the model -----------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
#: Fixed word lists of the span features.
_AT_WORDS = frozenset(("at", "arroba", "chez"))
_DOT_WORDS = frozenset(("dot", "punto", "point", "punkt"))
_ENDINGS = frozenset(("com", "org", "net", "edu", "gov", "info", "io", "br", "de", "es", "fr", "it", "pt", "uk", "us"))
_CUES = frozenset(("call", "phone", "tel", "fax", "mobile", "card", "visa", "account", "iban", "ssn", "mail", "email", "contact", "key", "token", "secret", "password", "passwd", "pwd", "api", "number", "social", "whatsapp"))
#: Where decoding may find something: digits, or a written-out dot.
_ZONE = re.compile(r"[0-9]+")
_GAP = re.compile(r"\s")
_DOTTED = re.compile(r" (?:dot|Dot|punto|point|punkt)(?= )")
_SECRETISH = re.compile(r"^[A-Za-z0-9_\-/+=.]+$")

_UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
_ISBN = re.compile(r"97[89][ -]?[0-9]{1,5}[ -]?[0-9]+[ -]?[0-9]+[ -]?[0-9]")
_YEAR = re.compile(r"\((?:1[5-9]|20)[0-9]{2}$")

_MARKS = frozenset(".-/()+ ")
_HEX = frozenset("0123456789abcdefABCDEF")
FEATURES = (
    "bias", "len1", "len2to3", "len4to9", "cue_before", "digits<7", "digits7to12", "digits13to19", "digits>19", "only_digits_and_marks",
    "groups_even", "starts_plus_or_paren", "luhn", "at_word_inside", "dot_word_inside", "letters_and_digits", "long_run", "solid_changes",
    "edge_mark", "has_space_letters", "all_letters", "hex", "digits_follow", "mark_and_digits_follow", "glued_before", "glued_after",
    "groups_3_3_4", "groups_3_2_4", "groups_4_4_4_4", "four_groups_to_3", "digits_before", "capitals_and_digits", "joined_by_a_mark_before", "one_kind_of_gap", "case_changes", "at_word_second", "space_before_at_word", "known_ending",
    "uuid", "in_link", "isbn", "ends_in_a_year_in_parentheses",
)
N_FEATURES = len(FEATURES)


def _digits_in(w: str) -> int:
    return 0 if w.isalpha() else len(w) if w.isdigit() else sum(map(str.isdigit, w))


def links(text: str, tokens: list[tuple[int, int]]) -> list[bool]:
    """For each token whether the run without spaces that it is in has begun as a link."""
    out, on = [], False
    for k, (s, e) in enumerate(tokens):
        gap = text[tokens[k - 1][1] : s] if k else " "
        on = on and not gap
        out.append(on)
        on = on or text[s:e] == "/" and text[s - 2 : s] == ":/" or e - s == 3 and text[s:e].lower() == "www"
    return out


def features(text: str, words: list[str], tokens: list[tuple[int, int]], i: int, j: int, linked: bool = False) -> np.ndarray:
    """Of the whole span of tokens i..j-1; ``words`` are the tokens in lower case."""
    span = text[tokens[i][0] : tokens[j - 1][1]]
    parts = words[i:j]
    groups = [w for w in parts if w.isdigit()]
    digits = sum(map(_digits_in, parts))
    letters = sum(len(w) for w in parts if w[0].isalnum()) - digits
    n = j - i
    solid = sum(map(len, parts)) == len(span)
    before = words[max(0, i - CONTEXT) : i]
    sizes = tuple(map(len, groups))
    at = next((x for x, w in enumerate(parts) if w in _AT_WORDS), 0)
    gaps = {text[tokens[x - 1][1] - 1 : tokens[x][0]] if not parts[x - i - 1].isdigit() else text[tokens[x - 1][1] : tokens[x][0]] for x in range(i + 1, j)} if n > 1 else set()
    return np.array((
        1, n == 1, 2 <= n <= 3, n > 3, not _CUES.isdisjoint(before), digits < 7, 7 <= digits < 13, 13 <= digits < 20, digits >= 20,
        digits > 0 and not letters and all(w in _MARKS or w.isdigit() for w in parts),
        len(groups) > 1 and max(map(len, groups)) <= 5,
        span[0] in "+(",
        16 <= digits <= 19 and luhn("".join(groups)),
        not _AT_WORDS.isdisjoint(parts[1:-1]), not _DOT_WORDS.isdisjoint(parts[1:-1]),
        solid and digits > 2 and letters > 2,
        solid and len(span) >= 16 and bool(_SECRETISH.match(span)),
        solid and n == 1,
        not span[-1].isalnum(),
        not solid and letters > 0,
        letters == len(span),
        solid and 16 <= len(span) <= 128 and not set(span) - _HEX,
        j < len(words) and words[j].isdigit() and tokens[j][0] - tokens[j - 1][1] <= 1,
        j + 1 < len(words) and words[j] in _MARKS and words[j + 1].isdigit() and tokens[j + 1][0] - tokens[j - 1][1] <= 2,
        i > 0 and tokens[i][0] == tokens[i - 1][1] and (words[i - 1][-1].isalnum() or i > 1 and words[i - 1] in _MARKS and words[i - 2].isdigit()),
        j < len(words) and tokens[j][0] == tokens[j - 1][1] and words[j][0].isalnum(),
        sizes == (3, 3, 4), sizes == (3, 2, 4), sizes == (4, 4, 4, 4),
        len(sizes) > 3 and max(sizes) < 4,
        i > 0 and words[i - 1].isdigit() and tokens[i][0] - tokens[i - 1][1] <= 1,
        solid and digits > 0 and len(span) >= 16 and span.isupper(),
        i > 1 and words[i - 1] in "_-" and tokens[i][0] == tokens[i - 1][1] and tokens[i - 1][0] == tokens[i - 2][1],
        len(gaps) == 1,
        solid and letters > 8 and not span.isupper() and not span.islower(),
        n > 1 and parts[1] in _AT_WORDS,
        at > 1 and any(tokens[i + x][0] > tokens[i + x - 1][1] for x in range(1, at)),
        parts[-1] in _ENDINGS,
        _UUID.fullmatch(span) is not None,
        linked,
        digits == 13 and not letters and _ISBN.fullmatch(span) is not None,
        _YEAR.search(span) is not None,
    ), float)


def candidates(text: str, tokens: list[tuple[int, int]], linked: list[bool] | None = None) -> list[tuple[int, int, np.ndarray]]:
    """Segments that may be an entity: seven digits, or a written-out at and dot, or a long solid run.
    Gaps are single characters and no line end."""
    out = []
    words = [text[a:b].lower() for a, b in tokens]
    weights = list(map(_digits_in, words))
    linked = links(text, tokens) if linked is None else linked
    for i, w in enumerate(words):
        if not (w[0].isalnum() or w in "+("):
            continue
        digits, handle, dot = 0, False, False
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            gap = tokens[j - 1][0] - tokens[j - 2][1] if j > i + 1 else 0
            if gap > 1 or gap and text[tokens[j - 1][0] - 1] == "\n":
                break
            digits += weights[j - 1]
            last = words[j - 1]
            if digits >= 7 or handle and dot or tokens[j - 1][1] - tokens[i][0] >= 16 and digits:
                if last[0].isalnum():
                    out.append((i, j, features(text, words, tokens, i, j, linked[i])))
            handle, dot = handle or j > i + 1 and last in _AT_WORDS, dot or handle and last in _DOT_WORDS
    return out


def _logsumexp(x: np.ndarray) -> float:
    m = x.max()
    return float(m + np.log(np.exp(x - m).sum()))


def lattice(n: int, cands: list[tuple[int, int, np.ndarray]], weights: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Scores of (candidate, kind), log of the partition sum, and the marginals of (candidate, kind)."""
    scores = np.array([f for _, _, f in cands]).reshape(-1, N_FEATURES) @ weights.T if cands else np.zeros((0, len(ADDED)))
    fwd, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    fwd[0] = back[n] = 0
    ends: dict[int, list[int]] = {}
    begins: dict[int, list[int]] = {}
    for c, (i, j, _) in enumerate(cands):
        ends.setdefault(j, []).append(c)
        begins.setdefault(i, []).append(c)
    for t in range(1, n + 1):
        fwd[t] = _logsumexp(np.concatenate([[fwd[t - 1]], *(fwd[cands[c][0]] + scores[c] for c in ends.get(t, []))]))
    for t in range(n - 1, -1, -1):
        back[t] = _logsumexp(np.concatenate([[back[t + 1]], *(back[cands[c][1]] + scores[c] for c in begins.get(t, []))]))
    marginal = np.array([np.exp(fwd[i] + scores[c] + back[j] - fwd[n]) for c, (i, j, _) in enumerate(cands)]).reshape(scores.shape)
    return scores, float(fwd[n]), marginal


def scored(text: str, tokens: list[tuple[int, int]], weights: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(i, j, kind, score) of the candidates that are worth more than none.  Those that begin in one window are scored
    at once, amid the tokens that their features look at."""
    linked = links(text, tokens)
    for at in range(0, len(tokens), WINDOW):
        lo, hi = max(0, at - CONTEXT), at + WINDOW + MAX_TOKENS + 1
        cands = [c for c in candidates(text, tokens[lo:hi], linked[lo:hi]) if at <= lo + c[0] < at + WINDOW]
        if cands:
            scores = np.array([f for _, _, f in cands]) @ weights.T
            for (i, j, _), kind, score in zip(cands, scores.argmax(1).tolist(), scores.max(1).tolist(), strict=True):
                if score > 0:
                    yield lo + i, lo + j, kind, score


def best(n: int, found: Iterable[tuple[int, int, int, float]]) -> list[tuple[int, int, str]]:
    """The best segmentation: dynamic programming over the positions."""
    ends: dict[int, list[tuple[int, int, float]]] = {}
    for i, j, kind, score in found:
        ends.setdefault(j, []).append((i, kind, score))
    if not ends:
        return []
    value, choice = [0.0] * (n + 1), [None] * (n + 1)
    for t in range(1, n + 1):
        value[t] = value[t - 1]
        for i, kind, score in ends.get(t, ()):
            if value[i] + score > value[t]:
                value[t], choice[t] = value[i] + score, (i, kind)
    out, t = [], n
    while t:
        if choice[t]:
            i, kind = choice[t]
            out.append((i, t, ADDED[kind]))
            t = i
        else:
            t -= 1
    return out[::-1]


def examples(n: int = 360, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Generated sentences and the character spans of their entities: entities with and without a cue word
    before them, harmless numbers, and tables of numbers."""
    r = random.Random(seed)
    vowel, cons = "aeiou", "bcdfghklmnprstvw"
    word = lambda: "".join(r.choice(cons) + r.choice(vowel) for _ in range(r.randint(1, 3)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    any_of = lambda letters, k: "".join(r.choice(letters) for _ in range(k))

    def entity() -> tuple[str, str]:
        k = r.randrange(11)
        if k == 0:
            return f"{word()} {r.choice(['at', 'arroba'])} {word()} {r.choice(sorted(_DOT_WORDS))} {r.choice(sorted(_ENDINGS))}", "handle"
        if k == 1:
            return f"{word()}.{word()} at {word()} dot {r.choice(sorted(_ENDINGS))}", "handle"
        if k == 2:
            return f"({digits(3)}) {digits(3)}-{digits(4)}", "number"
        if k in (3, 4):
            return r.choice(["-", ".", " "]).join((digits(3), digits(3), digits(4))), "number"
        if k == 5:
            return "-".join((digits(3), digits(2), digits(4))), "number"
        if k == 6:
            return r.choice([".", "/", " ", "-"]).join(digits(4) for _ in range(4)), "number"
        if k == 7:
            return any_of(upper + lower + "0123456789", r.randint(20, 36)), "secret"
        if k == 8:
            return any_of("0123456789abcdef", r.choice([32, 40])), "secret"
        if k == 9:
            return any_of(upper, 4) + any_of(upper + "0123456789", r.randint(11, 15)) + digits(1), "secret"
        if r.random() < 0.5:
            return f"{any_of(lower, r.randint(2, 4))}{r.choice('_-')}{any_of(upper + lower + '0123456789', r.randint(20, 36))}{digits(2)}", "secret"
        return f"{any_of(lower, 2)}_{r.choice(['live', 'test', 'prod'])}_{any_of(upper + lower + '0123456789', r.randint(16, 30))}{digits(2)}", "secret"

    def harmless() -> str:
        return r.choice([lambda: digits(r.randint(1, 4)), lambda: f"{digits(1)}.{digits(2)}", lambda: f"{word()} at {word()}", lambda: f"{word()} at the dot {word()}", lambda: f"{word()} at {word()} dot {word()}", lambda: f"{digits(2)}/{digits(2)}", lambda: f"{digits(1)},{digits(3)}", lambda: f"{word()}{digits(2)}", lambda: digits(5), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: digits(r.randint(7, 12)), lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"{digits(4)}-{digits(4)}", uuid, link, isbn, pages])()

    def uuid() -> str:
        return "-".join(any_of("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))

    def link() -> str:
        tail = r.choice([f"{digits(4)}/{digits(2)}/{word()}-{word()}-{digits(r.randint(5, 11))}", f"{word()}?{word()}={digits(10)}", any_of(upper + lower + "0123456789", r.randint(16, 30)), f"{word()}-{digits(3)}-{digits(3)}-{digits(4)}"])
        return f"{r.choice(['https://', 'http://', 'www.'])}{word()}.{r.choice(sorted(_ENDINGS))}/{word()}/{tail}"

    def isbn() -> str:
        body = r.choice([("978", digits(1), digits(2), digits(6), digits(1)), ("978", digits(2), digits(5), digits(2), digits(1)), ("979", digits(2), digits(4), digits(3), digits(1))])
        return r.choice(["ISBN ", "ISBN: ", ""]) + r.choice(["-", "-", " ", ""]).join(body)

    def pages() -> str:
        k = r.randint(2, 4)
        return f"{r.choice(['pp. ', 'p. ', ''])}{digits(k)}{r.choice('-–')}{digits(k)} ({r.choice(['19', '20'])}{digits(2)})"

    def row() -> str:
        """Numbers side by side."""
        width = r.choice([(1, 1), (2, 2), (3, 3), (1, 4), (2, 5), (4, 4)])
        return r.choice([" ", " ", ", ", "; "]).join(digits(r.randint(*width)) for _ in range(r.choice([5, 6, 7, 8, 12, 20])))

    def grid() -> str:
        return "\n".join(row() for _ in range(2))

    out = []
    for _ in range(n):
        text, spans = word(), []
        if r.random() < 0.12:
            out.append((f"{text} {r.choice([row, grid])()} {word()}", []))
            continue
        for _ in range(r.randint(2, 9)):
            text += r.choice([" ", " ", " ", ", "])
            x = r.random()
            if x < 0.2:
                if x < 0.1:
                    text += r.choice(sorted(_CUES)) + r.choice([" ", ": ", " is ", " of ", "="])
                e, kind = entity()
                spans.append((len(text), len(text) + len(e), kind))
                text += e
            else:
                text += harmless() if x < 0.42 else r.choice(sorted(_CUES)) if x < 0.46 else word()
        out.append((text + r.choice([".", ""]), spans))
    return out


@lru_cache(maxsize=1)
def train(steps: int = 40, rate: float = 1.0, ridge: float = 1e-3) -> bytes:
    """Weights (kind x feature), by ascent on the log-likelihood of generated examples; takes about two seconds."""
    w = np.zeros((len(ADDED), N_FEATURES))
    w[:, 0] = -1.0
    data = []
    for text, spans in examples():
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        cands = candidates(text, tokens)
        if not cands:
            continue
        gold = np.zeros((len(cands), len(ADDED)))
        for c, (i, j, _) in enumerate(cands):
            for a, b, kind in spans:
                if tokens[i][0] == a and tokens[j - 1][1] == b:
                    gold[c, ADDED.index(kind)] = 1
        data.append((len(tokens), cands, gold, np.array([f for _, _, f in cands])))
    square = np.zeros_like(w)
    for _ in range(steps):
        grad = -ridge * w * len(data)
        for n, cands, gold, f in data:
            grad += (gold - lattice(n, cands, w)[2]).T @ f
        grad /= len(data)
        square += grad * grad
        w += rate * grad / (np.sqrt(square) + 1e-8)
    return w.tobytes()


def zones(text: str) -> list[tuple[int, int]]:
    """Character ranges worth decoding, merged; each reaches some tokens to both sides, and then to white space, so that
    none ends inside a run of letters, digits and marks."""
    found = [m.span() for m in _ZONE.finditer(text)]
    if any(w in text for w in (" dot ", " Dot ", " punto ", " point ", " punkt ")):
        found = sorted(found + [m.span() for m in _DOTTED.finditer(text)])
    near: list[list[int]] = []
    for a, b in found:
        a, b = max(0, a - 40), min(len(text), b + 40)
        if near and a <= near[-1][1]:
            near[-1][1] = b
        else:
            near.append([a, b])
    out: list[list[int]] = []
    for a, b in near:
        floor = out[-1][1] if out else 0
        while a > floor and not text[a - 1].isspace():
            a -= 1
        end = _GAP.search(text, b) if b < len(text) and not text[b - 1].isspace() else None
        b = end.start() if end else b if text[b - 1].isspace() else len(text)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def added_spans(text: str, weights: np.ndarray, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    out = []
    for a, b in zones(text):
        part = text[a:b]
        tokens = [m.span() for m in _TOKEN.finditer(part)]
        # base spans are observed: their tokens part the zone and are never inside a candidate
        free: list[list[tuple[int, int]]] = [[]]
        for s, e in tokens:
            if any(s + a < y and e + a > x for _, x, y in taken if x < b and y > a):
                free.append([])
            else:
                free[-1].append((s, e))
        for run in free:
            for i, j, kind in best(len(run), scored(part, run, weights)):
                out.append((kind, a + run[i][0], a + run[j - 1][1]))
    return sorted(set(out), key=lambda s: (ADDED.index(s[0]), s[1], s[2]))


def spans(text: str | None, weights: np.ndarray) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans), in code points, ends exclusive."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, added_spans(text, weights, base)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and entities array<struct<kind, start, end, base>>."""
    raw = train()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = np.frombuffer(raw).reshape(len(ADDED), N_FEATURES)
        for pdf in frames:
            found = []
            for text in pdf["text"]:
                base, more = spans(text, w)
                found.append([{"kind": k, "start": a, "end": b, "base": i < len(base)} for i, (k, a, b) in enumerate([*base, *more])])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "entities": found})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, entities array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def listed(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def mask(text: str, found: list[tuple[str, int, int]]) -> str:
    """Spans replaced by <kind>; where spans overlap, the one that starts first, the longer one, wins."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(df: DataFrame, column: str = "text") -> DataFrame:
    """The same rows and columns, with every span of the text replaced by its kind in angle brackets."""
    raw = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(raw).reshape(len(ADDED), N_FEATURES)
        for batch in slices(batches, column):
            i = batch.schema.get_field_index(column)
            texts = [t if not t or not (s := [x for part in spans(t, w) for x in part]) else mask(t, s) for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    return df.mapInArrow(run, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    raw = train()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = np.frombuffer(raw).reshape(len(ADDED), N_FEATURES)
        for pdf in frames:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                base, more = spans(text, w)
                counts = [sum(k == kind for k, _, _ in base) for kind in BASE]
                rows.append((doc, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed([*base, *more])))
            yield pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return docs.mapInPandas(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
