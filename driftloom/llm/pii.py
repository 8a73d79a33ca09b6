"""Personal data by weak supervision.

Candidate spans come from strict patterns and from looser ones. Labelers vote on each candidate: the strict pattern,
gazetteers (top-level domains, issuer prefixes, calling codes, address ranges), the words around it, its form (check
digit, number of digits, mix of characters) and its borders. Expectation-maximisation over the counts of vote
patterns of the whole corpus estimates each labeler's reliability by kind; its posteriors train a logistic classifier
over the same votes, which decides on each candidate. Spans of the strict patterns always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tokens import release

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
#: Labelers and how reliable each is taken to be before any vote is seen; TRUST votes' worth, so the corpus decides.
LABELERS = {"pattern": 0.95, "gazetteer": 0.65, "context": 0.8, "form": 0.95, "borders": 0.55}
TRUST = 20.0

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Looser forms.
_EMAIL_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,5}")
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_PHONE_LOCAL = re.compile(r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{3}[.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|[A-Za-z0-9_-]{24,})(?![A-Za-z0-9_-])")
_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

# Gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz name io ai co app dev me tv uk de fr es it nl be ch at eu us ca au nz jp cn in br mx ru pl se no dk fi pt ie cz gr tr za kr".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38|50|5[6-8]|6[0-9]")
NEAR = {
    "email": "mail email e-mail contact write courriel correo kontakt to from cc",
    "ip": "ip address host server addr adresse from client peer inet",
    "card": "card visa mastercard amex credit debit karte carte tarjeta pan payment",
    "phone": "phone tel call mobile fax cell telefon téléphone teléfono sms whatsapp contact",
    "secret": "token key secret password passwd pwd apikey api_key auth bearer credential",
}
NEAR = {k: frozenset(v.split()) for k, v in NEAR.items()}
NOT_NEAR = frozenset("version v release section chapter isbn issn invoice order tracking serial page article figure table sha commit checksum md5 uuid".split())
_WORD = re.compile(r"[^\W_]+(?:[-_][^\W_]+)*")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def candidates(text: str | None) -> list[tuple[str, int, int, bool, tuple[int, ...]]]:
    """(kind, start, end, strict, votes) by start and kind; offsets in code points."""
    if not text:
        return []
    found: list[tuple[str, int, int, bool]] = []
    if "@" in text:
        found += [("email", a, b, True) for a, b in _emails(text)]
    if "at]" in text or "at)" in text:
        found += [("email", *m.span(), False) for m in _EMAIL_SPELT.finditer(text)]
    if _DIGIT.search(text):
        found += [("ip", *m.span(), all(map(_small, m[0].split(".")))) for m in _IP.finditer(text)]
        found += [("ip", *m.span(), False) for m in _IP6.finditer(text)] if ":" in text else []
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 12 <= len(d) <= 19:
                found.append(("card", *m.span(), luhn(d)))
        found += [("phone", *m.span(), True) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
        found += [("phone", *m.span(), False) for m in _PHONE_LOCAL.finditer(text)]
        found += [("secret", *m.span(), False) for m in _SECRET.finditer(text) if _DIGIT.search(m[0]) and any(map(str.isalpha, m[0]))]
    # A looser candidate yields to strict ones that it overlaps, and to an earlier looser one of its kind.
    strict = sorted((a, b) for _, a, b, s in found if s)
    out, last = [], {}
    for kind, a, b, s in sorted(found, key=lambda x: (x[1], KINDS.index(x[0]))):
        if not s and (any(x < b and a < y for x, y in strict) or a < last.get(kind, 0)):
            continue
        last[kind] = max(last.get(kind, 0), b)
        out.append((kind, a, b, s, _votes(text, kind, a, b, s)))
    return out


def _votes(text: str, kind: str, a: int, b: int, strict: bool) -> tuple[int, ...]:
    x = text[a:b]
    d = _digits(x)
    before = {w.lower() for w in _WORD.findall(text[max(0, a - 40) : a])[-4:]}
    if kind == "email":
        listed = re.split(r"[\W_]+", x.rstrip("])"))[-1].lower() in TOP_DOMAINS
        form = not x.startswith((".", "-")) and len(x) <= 254
    elif kind == "ip":
        first = x.split(".")[0].lstrip("0")
        listed = ":" in x or (len(first) <= 3 and 1 <= int(first or 0) <= 239)
        form = ":" in x or all(map(_small, x.split(".")))
    elif kind == "card":
        listed, form = bool(_ISSUERS.match(d)), luhn(d)
    elif kind == "phone":
        code = d[2:] if d.startswith("00") else d
        listed = not x.startswith(("+", "00")) and len(d) == 10 or any(code.startswith(c) for c in CALLING_CODES)
        form = 9 <= len(d) <= 15
    else:
        hexed = all(c in "0123456789abcdefABCDEF" for c in x)
        listed = hexed and len(x) in (32, 40, 64) or x.startswith(("sk-", "ghp_", "AKIA", "ASIA", "xox"))
        form = len(d) >= len(x) / 10 and len(set(x)) >= 8
    near = 1 if before & NEAR[kind] else -1 if before & NOT_NEAR else 0
    open_ = (not a or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
    return (1 if strict else 0, 1 if listed else -1, near, 1 if form else -1, 1 if open_ else -1)


def code_of(kind: str, votes: tuple[int, ...]) -> int:
    code = KINDS.index(kind)
    for v in votes:
        code = 3 * code + v + 1
    return code


def reliabilities(votes: np.ndarray, counts: np.ndarray, *, rounds: int = 500, trust: float = TRUST) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns (rows of -1, 0, 1) of one kind and their counts: posterior by pattern, reliability by
    labeler and the share of candidates that are personal data. A labeler that votes is right with its reliability and
    says nothing when it abstains; the votes' worth of what is taken beforehand keeps the two classes apart and is
    outweighed by the corpus."""
    before = np.array(list(LABELERS.values()))
    right, share = before, 0.5
    p = np.full(len(votes), 0.5)
    for _ in range(rounds):
        new = 1 / (1 + np.exp(-np.log(share / (1 - share)) - (votes * np.log(right / (1 - right))).sum(1)))
        done = np.abs(new - p).max(initial=0) < 1e-9
        p = new
        if done:
            break
        agree = np.where(votes > 0, p[:, None], np.where(votes < 0, 1 - p[:, None], 0)) * counts[:, None]
        right = (agree.sum(0) + trust * before) / (((votes != 0) * counts[:, None]).sum(0) + trust)
        share = ((p * counts).sum() + trust / 2) / (counts.sum() + trust)
    return p, right, share


def fit(codes: np.ndarray, counts: np.ndarray, *, ridge: float = 1e-3) -> dict[int, float]:
    """Probability that a candidate is personal data, by code (kind and votes).

    ``reliabilities`` by kind, then logistic regression on kind and votes, with the posteriors as soft labels and the
    counts as weights (Newton's method; at most kinds times 3 ** labelers rows)."""
    codes, counts = np.asarray(codes, np.int64), np.asarray(counts, float)
    if not len(codes):
        return {}
    n = len(LABELERS)
    votes = np.stack([codes // 3 ** (n - 1 - k) % 3 - 1 for k in range(n)], axis=1)
    kind = codes // 3**n
    soft = np.zeros(len(codes))
    for k in np.unique(kind):
        soft[kind == k] = reliabilities(votes[kind == k], counts[kind == k])[0]
    X = np.concatenate([np.eye(len(KINDS))[kind], *((votes == v).astype(float) for v in (-1, 1))], axis=1)
    b = np.zeros(X.shape[1])
    weight = counts / counts.sum()
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(X @ b, -30, 30)))
        g = X.T @ (weight * (q - soft)) + ridge * b
        H = (X * (weight * q * (1 - q))[:, None]).T @ X + ridge * np.eye(len(b))
        step = np.linalg.solve(H, g)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(codes.tolist(), (1 / (1 + np.exp(-np.clip(X @ b, -30, 30)))).tolist(), strict=True))


def pattern_counts(docs: DataFrame, text_col: str = "text") -> list[tuple[int, int]]:
    """How often each code occurs in the corpus; the rows are bounded by the codes there are."""

    def run(batches):
        release()
        for b in batches:
            c = Counter(code_of(kind, v) for x in b.column(0).to_pylist() for kind, _, _, _, v in candidates(x))
            yield pa.RecordBatch.from_pydict({"code": pa.array(list(c), pa.int32()), "n": pa.array(list(c.values()), pa.int64())})

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return sorted((r["code"], r["n"]) for r in rows)


def spans_of(text: str | None, model: dict[int, float], accept: float) -> list[tuple[str, int, int, bool, float]]:
    """Accepted spans (kind, start, end, strict, probability)."""
    out = []
    for kind, a, b, strict, votes in candidates(text):
        p = model.get(code_of(kind, votes), 0.0)
        if strict or p >= accept:
            out.append((kind, a, b, strict, p))
    return out


def redacted(text: str | None, spans: list[tuple]) -> str | None:
    """The text with each span's place taken by its kind; of overlapping spans the first gives the kind."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b, *_ in spans:
        if a >= at:
            out += (text[at:a], f"<{kind}>")
        at = max(at, b)
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("strict", pa.bool_()), ("probability", pa.float64())]))


def train(docs: DataFrame, *, text_col: str = "text") -> dict[int, float]:
    seen = pattern_counts(docs, text_col)
    return fit(np.array([c for c, _ in seen], np.int64), np.array([n for _, n in seen], float))


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.5, model: dict[int, float] | None = None, with_text: bool = False) -> DataFrame:
    """One row per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the strict spans), spans (kind, start,
    end, strict, probability) and with ``with_text`` redacted_text.

    Two passes over the texts, the first for the counts of vote patterns; nothing is shuffled but these. NULL or
    empty text has no spans; NULL or repeated doc_id gives a row of its own; an empty table gives no rows."""
    model = train(docs, text_col=text_col) if model is None else model

    def run(batches):
        release()
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                spans = spans_of(text, model, accept)
                base = [s for s in spans if s[3]]
                n = Counter(s[0] for s in base)
                digest = hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z, *_ in base).encode()).hexdigest()
                rows.append((*(n[k] for k in BASE_KINDS), digest, [dict(zip(("kind", "start", "end", "strict", "probability"), s, strict=True)) for s in spans], redacted(text, spans) if with_text else None))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            data = {"doc_id": b.column(0)} | {f"n_{k}": pa.array(cols[i], pa.int64()) for i, k in enumerate(BASE_KINDS)} | {"base_sha256": pa.array(cols[4], pa.string()), "spans": pa.array(cols[5], _SPANS)}
            yield pa.RecordBatch.from_pydict(data | ({"redacted_text": pa.array(cols[6], pa.string())} if with_text else {}))

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans array<struct<kind: string, start: long, end: long, strict: boolean, probability: double>>" + ", redacted_text string" * with_text
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, *, text_col: str = "text", accept: float = 0.5, model: dict[int, float] | None = None) -> DataFrame:
    """The rows with their personal data replaced by kinds; all other columns as they are."""
    model = train(docs, text_col=text_col) if model is None else model

    def run(batches):
        release()
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts = [redacted(x, spans_of(x, model, accept)) for x in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at).name, pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
