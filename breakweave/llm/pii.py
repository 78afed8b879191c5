"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a classifier decides."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The base kinds, in the order of ties, then the kinds that only the method finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "iban", "name", "address", "birth", "secret")
#: Added spans need this probability.
THRESHOLD = 0.9
#: Characters before and after a span in which the context labelers look.
BEFORE, AFTER = 40, 24
#: EM sees each kind's candidates as so many votes, whatever the size of the corpus, with so many
#: made-up ones of labelers that are right as often as ``START`` says.
VOTES, MADE_UP = 1_000.0, 50.0
#: The most terms of gazetteers, which every task holds.
MAX_TERMS = 1_000_000

AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Candidates of the method: wider forms than the base ones.
AT_WORD = re.compile(r"[\[({] ?at ?[\])}]", re.I)
AT_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?\Z")
AT_HOST = re.compile(r" ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9-]{2,63}){1,4}", re.I)
NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
DATE = re.compile(r"(?<![0-9])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9])")
STREET = re.compile(
    r"(?<![0-9])[0-9]{1,5} (?:[A-Z][a-z]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard)\b"
    r"|\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|weg|platz) [0-9]{1,4}\b"
)
NAME = re.compile(r"\b[A-ZÀ-Þ][a-zß-ÿ]{1,20} [A-ZÀ-Þ][a-zß-ÿ]{1,20}\b")

SECRET = re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+-]{16,200}={0,2}(?![A-Za-z0-9_/+=-])")

# Fixed word lists: default gazetteers and words that announce a kind, or something else.
GAZETTEERS = {
    "name": """james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth
    barbara susan jessica sarah karen nancy lisa margaret emily anna maria peter paul hans klaus jürgen wolfgang
    ursula monika petra sabine heike andreas stefan jean pierre michel philippe marie nathalie isabelle sophie
    jose juan carlos luis antonio manuel francisco carmen isabel laura pablo miguel ana""".split(),
    "email": "com org net edu gov de fr es uk io it nl eu info".split(),
    "phone": "+1 +33 +34 +39 +44 +49".split(),
    "iban": "AT BE CH DE ES FR GB IE IT LU NL PL PT SE".split(),
    "secret": "AKIA ASIA ghp_ gho_ github_pat_ sk_live_ sk_test_ pk_live_ xoxb- xoxp- glpat- eyJ AIza".split(),
}
TITLES = ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "señor", "señora", "monsieur", "madame", "sir")
CUES = {
    "email": ("mail", "email", "contact", "write", "reach", "kontakt", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono", "cell", "number", "ring"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "name": ("name", "signed", "regards", "called", "author", *TITLES),
    "address": ("address", "live", "lives", "street", "wohnt", "habite", "vive"),
    "birth": ("born", "birth", "dob", "geboren", "né", "née", "nacido", "nacida"),
    "secret": ("token", "key", "apikey", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "credentials"),
}
AGAINST = frozenset(
    """version isbn order invoice serial issue page figure build part item article model reference ref ticket commit sha md5
    checksum digest hash uuid published updated posted date""".split()
)

#: Votes: 2 for, 1 against, 0 abstains.
LABELERS = ("form", "gazetteer", "before", "after", "edges")
#: How often each is taken to be right, when it votes, before EM has looked: a good form alone says little.
START = (0.65, 0.8, 0.9, 0.8, 0.55)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the base pattern, found from each @ so that long runs cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = AT_DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base matches that pass their checks, by start and then kind."""
    found = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
                found.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _wide(text: str) -> Iterator[tuple[str, int, int]]:
    for m in AT_WORD.finditer(text):
        left = AT_LOCAL.search(text[max(0, m.start() - 65) : m.start()])
        right = AT_HOST.match(text, m.end())
        if left and right:
            yield "email", m.start() - len(left.group()), right.end()
    if DIGIT.search(text):
        for kind, pattern in (("phone", NATIONAL), ("ssn", SSN), ("iban", IBAN), ("birth", DATE), ("address", STREET)):
            for m in pattern.finditer(text):
                yield kind, m.start(), m.end()
        for m in SECRET.finditer(text):
            span = m.group()
            if DIGIT.search(span) and any(c.isalpha() for c in span) and "-" not in (span[0], span[-1]):
                yield "secret", m.start(), m.end()
    for m in NAME.finditer(text):
        yield "name", m.start(), m.end()


def entropy(text: str) -> float:
    """Bits a character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def _form(kind: str, span: str) -> int:
    """Whether the span is well formed beyond its pattern."""
    digits = re.sub("[^0-9]", "", span)
    if kind == "phone":
        return 2 if span[0] == "+" or digits[0] > "1" and digits[3] > "1" else 1
    if kind == "ssn":
        return 1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 2
    if kind == "iban":
        s = span.replace(" ", "")
        return 2 if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 else 1
    if kind == "card":
        return 2 if digits[0] in "3456" else 1
    if kind == "email":
        return 2 if "@" in span else 0
    if kind == "birth":
        a, b, c = (int(x) for x in re.split("[./-]", span))
        year, rest = (a, (b, c)) if a > 31 else (c, (a, b))
        return 2 if 1900 <= year <= 2025 and min(rest) in range(1, 13) and max(rest) in range(1, 32) else 1
    if kind == "secret":
        mixed = bool(digits) and any(c.isalpha() for c in span)
        return 2 if mixed and len(span) >= 20 and entropy(span) >= 3.0 else 1
    return 0


def _gazetteer(kind: str, span: str, terms: Mapping[str, frozenset[str]]) -> int:
    known = terms.get(kind, frozenset())
    if kind == "name":
        return 2 if span.split()[0].lower() in known else 1
    if kind == "email":
        return 2 if re.split(r"[.\s\])}]+", span.strip(" )]}"))[-1].lower() in known else 0
    if kind == "iban":
        return 2 if span[:2] in known else 1
    if kind in ("phone", "secret"):
        return 2 if any(span[:n] in known for n in range(2, 12)) else 0
    return 0


def _context(kind: str, around: str) -> int:
    words = {w.lower() for w in re.findall(r"[^\W\d_]+", around)}
    if not words.isdisjoint(CUES[kind]):
        return 2
    return 0 if words.isdisjoint(AGAINST) else 1


def _edges(left: str, right: str) -> int:
    """Whether a span stands alone: quoted, between blanks, or before a mark that ends a clause."""
    if left.isalnum() or right.isalnum() or left in "/\\_#@&%=" and left.strip() or right in "/\\_#@&%" and right.strip():
        return 1
    return 2


def candidates(
    text: str, base: list[tuple[str, int, int]], terms: Mapping[str, frozenset[str]]
) -> list[tuple[str, int, int, str]]:
    """Base spans and wider ones apart from them, each with its signature: kind, votes and outer form."""
    starts, ends = [], []
    for _, a, b in base:  # in order of their starts; spans that overlap become one range
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    spans = list(base)
    last = -1
    for k, a, b in sorted(set(_wide(text)), key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        at = bisect_left(starts, b)  # the ranges before this index start before the span ends
        if a >= last and not (at and ends[at - 1] > a):
            spans.append((k, a, b))
            last = b
    out = []
    for k, a, b in spans:
        span = text[a:b]
        left, right = text[a - 1 : a] if a else " ", text[b : b + 1] or " "
        votes = (
            _form(k, span),
            _gazetteer(k, span, terms),
            _context(k, text[max(0, a - BEFORE) : a]),
            _context(k, text[b : b + AFTER]),
            _edges(left, right),
        )
        outer = "".join("w" if c.isalnum() else "s" if c.isspace() else "p" for c in (left, right))
        out.append((k, a, b, f"{k}|{''.join(map(str, votes))}|{outer}|{min(3, (b - a) // 8)}"))
    return out


class Reliabilities:
    """What EM estimates. ``prior``: by kind; ``right``: labeler x class x (against, for), of those that vote;
    ``voting``: kind x labeler x class, how often a labeler votes at all. Class 1 is personal data."""

    def __init__(self, kinds: list[str]):
        self.kinds = kinds
        self.prior = np.full(len(kinds), 0.5)
        self.right = np.array([[[p, 1 - p], [1 - p, p]] for p in START])
        self.voting = np.full((len(kinds), len(LABELERS), 2), 0.5)

    def posterior(self, kind: np.ndarray, votes: np.ndarray) -> np.ndarray:
        """P(class 1) of candidates of these kinds (by index) and votes."""
        total = np.log(self.prior[kind]) - np.log(1 - self.prior[kind])
        for j in range(len(LABELERS)):
            total = total + self.weight(j, kind, votes[:, j])
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))

    def weight(self, j: int, kind: np.ndarray, vote: np.ndarray) -> np.ndarray:
        """Log ratio by which a labeler's vote, or its abstention, speaks for class 1."""
        p = self.voting[kind, j]
        spoke = np.log(p[:, 1] / p[:, 0])
        silent = np.log((1 - p[:, 1]) / (1 - p[:, 0]))
        said = np.log(self.right[j, 1] / self.right[j, 0])
        # a labeler's presence alone must not outweigh what it says
        return np.where(vote == 0, np.clip(silent, -1.5, 1.5), np.clip(spoke, -1.5, 1.5) + said[np.maximum(vote, 1) - 1])


def em_reliabilities(patterns: Mapping[tuple[str, str], float], rounds: int = 100) -> Reliabilities:
    """Reliabilities of the labelers from counts of (kind, votes), by expectation-maximisation.

    Each labeler abstains, speaks against or for, with probabilities of their own for both classes:
    how often it speaks depends on the kind, how often it is right does not. Counts enter as shares
    of their kind, so the result does not change with the size of the corpus.
    """
    keys = sorted(patterns)
    found = Reliabilities(sorted({k for k, _ in keys}))
    kind = np.array([found.kinds.index(k) for k, _ in keys], dtype=int)
    votes = np.array([[int(v) for v in vote] for _, vote in keys], dtype=int).reshape(len(keys), len(LABELERS))
    n = np.array([patterns[k] for k in keys], dtype=float)
    n *= VOTES / np.bincount(kind, n, minlength=len(found.kinds))[kind]
    start = Reliabilities(found.kinds).right
    for _ in range(rounds):
        yes = found.posterior(kind, votes)
        mass = np.stack([n * (1 - yes), n * yes], axis=1)
        by_kind = np.stack([np.bincount(kind, mass[:, y], minlength=len(found.kinds)) for y in (0, 1)], axis=1)
        found.prior = np.clip((by_kind[:, 1] + MADE_UP / 2) / (by_kind.sum(axis=1) + MADE_UP), 0.02, 0.98)
        for j in range(len(LABELERS)):
            said = np.stack([mass[votes[:, j] == v].sum(axis=0) for v in (1, 2)], axis=1) + MADE_UP * start[j]
            said /= said.sum(axis=1, keepdims=True)
            if said[1, 1] < said[0, 1]:  # no labeler is worse than chance
                said[:] = said.mean(axis=0)
            found.right[j] = said
            spoke = mass * (votes[:, j] > 0)[:, None]
            overall = (spoke.sum() + 1) / (mass.sum() + 2)
            for y in (0, 1):
                of_kind = np.bincount(kind, spoke[:, y], minlength=len(found.kinds))
                found.voting[:, j, y] = np.clip((of_kind + MADE_UP * overall) / (by_kind[:, y] + MADE_UP), 0.001, 0.999)
    return found


def _design(signatures: Iterable[str]) -> np.ndarray:
    """0/1 features of signatures: kind, each vote, the kind's balance of votes, characters around, length."""
    rows = []
    for s in signatures:
        kind, votes, outer, size = s.split("|")
        row = [1.0, *(float(kind == k) for k in KINDS)]
        for v in votes:
            row += [float(v == "1"), float(v == "2")]
        balance = sum((v == "2") - (v == "1") for v in votes)
        row += [balance * float(kind == k) for k in KINDS]
        for c in outer:
            row += [float(c == "w"), float(c == "p")]
        row += [float(size == str(i)) for i in range(4)]
        rows.append(row)
    return np.array(rows)


def train_classifier(counts: Mapping[str, int], rounds: int = 400) -> dict[str, float]:
    """Probability of each signature: a logistic regression fitted to the posteriors that EM gives.

    ``counts`` holds every signature of the corpus; their number is bounded by the vote patterns,
    whatever the size of the corpus.
    """
    if not counts:
        return {}
    names = sorted(counts)
    patterns: Counter = Counter()
    for s in names:
        kind, votes, *_ = s.split("|")
        patterns[kind, votes] += counts[s]
    found = em_reliabilities(patterns)
    kind = np.array([found.kinds.index(s.split("|")[0]) for s in names])
    y = found.posterior(kind, np.array([[int(v) for v in s.split("|")[1]] for s in names]))
    x = _design(names)
    # rare signatures count too: their weight is the root of their share of their kind
    n = np.array([counts[s] for s in names], dtype=float)
    weight = np.sqrt(n / np.bincount(kind, n)[kind])
    weight /= weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-4 * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (weight * (p - y)) + 1e-4 * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(names, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))


def _joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPAN = "array<struct<kind string, start int, `end` int, signature string>>"


def gazetteer_terms(gazetteers: DataFrame | None = None) -> dict[str, frozenset[str]]:
    """Terms by kind, from a table of ``kind, term`` or the default lists; at most ``MAX_TERMS``."""
    if gazetteers is None:
        return {k: frozenset(v) for k, v in GAZETTEERS.items()}
    rows = gazetteers.where("kind is not null and term is not null").select("kind", "term").distinct().limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    found: dict[str, set[str]] = {}
    for r in rows:
        found.setdefault(r.kind, set()).add(r.term.lower() if r.kind in ("name", "email") else r.term)
    return {k: frozenset(v) for k, v in found.items()}


def label_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gazetteers: DataFrame | None = None
) -> DataFrame:
    """``id_col, n_email, n_ip, n_card, n_phone, base, candidates``: one pass over the whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(gazetteer_terms(gazetteers))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("signature", pa.string())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, bases, found = [], [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                counts.append([sum(s[0] == k for s in base) for k in BASE_KINDS])
                bases.append(_joined(base))
                found.append([dict(zip(("kind", "start", "end", "signature"), c)) for c in candidates(text, base, shared.value)])
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(bases, pa.string()), pa.array(found, kind)],
                [id_col, *(f"n_{k}" for k in BASE_KINDS), "base", "candidates"],
            )

    kind_of_id = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind_of_id}, n_email long, n_ip long, n_card long, n_phone long, base string, candidates {SPAN}"
    return docs.select(id_col, text_col).mapInArrow(apply, schema)


def find_pii(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    gazetteers: DataFrame | None = None,
) -> DataFrame:
    """Personal data of each document: counts and spans of the base kinds, and the spans that the
    trained classifier adds.

    Returns one row per input row: ``id_col, n_email, n_ip, n_card, n_phone, base`` (base spans as
    ``kind:start:end``, code points, comma-joined), ``spans`` (the base spans and the added ones),
    ``n_spans``, ``n_added``. Base spans always stay; an added span never overlaps one.
    ``gazetteers`` (kind, term) replaces the default lists: lower-case given names, top-level domains,
    calling codes, country codes of accounts, prefixes of secrets. A null text counts as
    empty; null ids and repeated rows keep their rows; an empty table gives an empty result.
    """
    labelled = materialize(label_spans(docs, id_col, text_col, gazetteers), "pii-candidates")
    seen = labelled.select(F.explode("candidates.signature").alias("s")).groupBy("s").count()
    probability = train_classifier({r["s"]: r["count"] for r in seen.collect()})  # a bounded set of signatures
    accepted = frozenset(s for s, p in probability.items() if p >= threshold)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            spans, added, every = [], [], []
            for base, found in zip(batch.column(at["base"]).to_pylist(), batch.column(at["candidates"]).to_pylist()):
                kept = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base.split(",") if s)]
                have = set(kept)
                more = [
                    (c["kind"], c["start"], c["end"])
                    for c in found
                    if c["signature"] in accepted and (c["kind"], c["start"], c["end"]) not in have
                ]
                spans.append(_joined(sorted(kept + more, key=lambda s: (s[1], KINDS.index(s[0])))))
                added.append(len(more))
                every.append(len(kept) + len(more))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for n, i in at.items() if n != "candidates"), pa.array(spans, pa.string()), pa.array(every, pa.int64()), pa.array(added, pa.int64())],
                [*(n for n in at if n != "candidates"), "spans", "n_spans", "n_added"],
            )

    columns = [f"`{n}` {t}" for n, t in labelled.dtypes if n != "candidates"]
    return labelled.mapInArrow(apply, ", ".join([*columns, "spans string", "n_spans long", "n_added long"]))


