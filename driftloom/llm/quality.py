"""Quality rules as weak supervision.

Each rule votes good, bad or abstains. Expectation-maximisation over the counts of vote patterns of the whole
corpus estimates how often each rule casts each vote on good and on bad documents; the posterior probability of
"good" then decides, instead of asking that all rules pass.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import SPACES, stage
from ._tokens import release

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    w.encode()
    for w in (
        "the of and to in is that it for was on are as with be by at from or an this have which not "
        "der die das und ist von mit den im zu für auf ein eine nicht sich des dem als auch "
        "le la les de des et est que un une dans pour sur par avec qui du en ne pas "
        "el los las y que se por con para una su al lo como del es no"
    ).split()
)
RULES = ("length", "word_length", "symbols", "repeated_lines", "repeated_words", "capitals", "sentence_ends", "stop_words", "distinct_words", "exclamations")
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_UPPER = re.compile("[A-ZÀ-ÖØ-Þ]")
_FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = ", ".join(f"{c} long" for c in _FEATURES) + ", base_failed boolean, pattern int"


def repeat_words(words: list) -> int:
    """Words in windows of 3 words that occur twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    count = Counter(zip(words, words[1:], words[2:]))
    if len(count) == n - 2:
        return 0
    covered, upto = 0, 0
    for i, c in enumerate(map(count.__getitem__, zip(words, words[1:], words[2:]))):
        if c > 1:
            covered += i + 3 - max(upto, i)
            upto = i + 3
    return covered


def measure(text: str | None) -> tuple[dict[str, float], list[int]]:
    """Features of one text and its rules' votes (1 good, -1 bad, 0 abstains)."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    n_spaces = len(raw) - len(raw.translate(None, SPACES))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    f = {
        "n_words": n,
        "word_chars": len(text) - n_spaces,
        "n_symbols": len(raw) - len(raw.translate(None, b"#*$%&|<>")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat_words(words),
    }
    f["base_failed"] = n < MIN_WORDS or 100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * n
    if not n:
        return f, [-1] + [0] * (len(RULES) - 1)
    letters, distinct = f["word_chars"], len(set(words))
    mean, sym, rep = letters / n, f["n_symbols"] / n, f["n_repeat_words"] / n
    upper = len(_UPPER.findall(text)) / max(1, letters)
    ends = sum(w.endswith((b".", b"!", b"?", b";", b":", b"\xe2\x80\xa6", b"\xe3\x80\x82")) for w in words) / n
    stop = sum(map(STOP_WORDS.__contains__, words)) / n
    shout = raw.count(b"!") / n
    dup = f["n_dup_lines"] / max(1, len(lines))
    few = n < MIN_WORDS
    votes = [
        -1 if n < 10 else 0 if few else 1,
        -1 if mean < 3 or mean > 10 else 1 if 4 <= mean <= 8 else 0,
        -1 if sym > 0.2 else 1 if sym < 0.02 else 0,
        0 if len(lines) < 2 else -1 if dup > 0.35 else 1 if dup < 0.1 else 0,
        0 if few else -1 if rep > 0.4 else 1 if rep < 0.15 else 0,
        -1 if upper > 0.3 else 1 if upper < 0.1 else 0,
        0 if few else -1 if ends < 0.005 else 1 if 0.02 <= ends <= 0.4 else 0,
        0 if few else -1 if stop < 0.002 else 1 if stop >= 0.03 else 0,
        0 if few or n > 5000 else -1 if distinct < 0.2 * n else 1 if distinct > 0.4 * n else 0,
        -1 if shout > 0.3 else 1 if shout < 0.05 else 0,
    ]
    return f, votes


def pattern_of(votes: list[int]) -> int:
    code = 0
    for v in votes:
        code = 3 * code + v + 1
    return code


def votes_of(pattern: np.ndarray, n_rules: int = len(RULES)) -> np.ndarray:
    """Rows of vote indices 0 (bad), 1 (abstains), 2 (good)."""
    return np.stack([pattern // 3 ** (n_rules - 1 - k) % 3 for k in range(n_rules)], axis=1)


def fit(patterns: np.ndarray, counts: np.ndarray, n_rules: int = len(RULES), *, rounds: int = 500, smooth: float = 1.0, trust: float = 4.0) -> dict:
    """Expectation-maximisation on vote patterns and their counts.

    A document is good (class 0) or bad in the way that one of the rules looks for (class 1 + rule): documents that
    are bad in different ways have hardly a vote in common, and one class of bad would fit only the commonest way.
    Returns posterior (of "good", by pattern), prior (by class) and rates[class, rule, vote], the estimated chances
    of a vote 0 bad, 1 good where the rule doesn't abstain; an abstention says nothing. It begins with soft votes: the
    sum of a pattern's votes gives the odds of "good", and its rules' votes share out the rest. That rules are right
    more often than wrong enters as ``trust`` further votes for each (good ones on good documents, bad ones on
    documents with the rule's own fault), beside ``smooth`` of either kind; the corpus outweighs them. So a rule whose
    bad votes come with others' good ones is overruled, and several weak bad votes can outweigh good ones. Nothing
    but the votes breaks ties, so the result depends on the counts alone."""
    patterns, counts = np.asarray(patterns, np.int64), np.asarray(counts, float)
    rules = np.arange(n_rules)
    base = np.full((1 + n_rules, n_rules, 2), smooth)
    base[0, :, 1] += trust
    base[1 + rules, rules, 0] += trust
    if not len(patterns):
        return {"posterior": np.empty(0), "prior": np.full(1 + n_rules, 1 / (1 + n_rules)), "rates": base / base.sum(2, keepdims=True)}
    votes = votes_of(patterns, n_rules)
    hot = np.stack([votes == 0, votes == 2], axis=2).astype(float)
    signed = votes - 1.0
    good = 1 / (1 + np.exp((signed != 0).sum(1) / 2 - signed.sum(1)))
    own = np.exp(-signed)
    p = np.concatenate([good[:, None], (1 - good[:, None]) * own / own.sum(1, keepdims=True)], axis=1)
    for _ in range(rounds):
        weight = p * counts[:, None]
        prior = (weight.sum(0) + smooth) / (weight.sum() + smooth * (1 + n_rules))
        rates = np.einsum("pc,prv->crv", weight, hot) + base
        rates /= rates.sum(2, keepdims=True)
        log = np.log(prior) + np.einsum("prv,crv->pc", hot, np.log(rates))
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - p).max() < 1e-6
        p = new
        if done:
            break
    return {"posterior": p[:, 0], "prior": prior, "rates": rates}


def _model(seen: DataFrame) -> list[tuple[int, float]]:
    """(pattern, posterior) from a table (pattern, count) of 3 ** rules rows at most."""
    rows = sorted((r["pattern"], r["count"]) for r in seen.collect())
    model = fit(np.array([p for p, _ in rows], np.int64), np.array([c for _, c in rows], float))
    return [(p, float(x)) for (p, _), x in zip(rows, model["posterior"], strict=True)]


def keep_good(docs: DataFrame, *, text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """The rows that ``quality_rules`` keeps, with all their columns, whatever their names.

    Rows carry their votes while the counts are taken, so no verdict has to find its row again: rows of a NULL or
    repeated id each have their own."""
    mark = "votes"
    while mark in docs.columns:
        mark += "_"

    def run(batches):
        release()
        for b in batches:
            found = [measure(x) for x in b.column(text_col).to_pylist()]
            yield b.append_column(mark, pa.array([2 * pattern_of(v) + f["base_failed"] for f, v in found], pa.int32()))

    held = stage(docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(mark, T.IntegerType())])), "quality")
    seen = held.groupBy(F.shiftright(mark, 1).alias("pattern")).count()
    good = [(2 * p,) for p, x in _model(seen) if x >= keep_at]
    return held.join(F.broadcast(docs.sparkSession.createDataFrame(good, f"{mark} int")), mark, "left_semi").select(*docs.columns)


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """Features, posterior and verdict of each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, posterior.

    Features are measured once and staged; the pattern counts that go to the driver are 3 ** rules rows at most,
    whatever the corpus, and so is the table that is joined back by broadcast. NULL or empty text has no words, so
    its base fails; texts are taken whole; a NULL doc_id or one that repeats gives a row of its own; a posterior of just
    ``keep_at`` keeps; an empty table gives no rows; other columns are left alone."""

    def run(batches):
        release()
        for b in batches:
            found = [measure(x) for x in b.column(1).to_pylist()]
            data = {"doc_id": b.column(0)} | {c: pa.array([f[c] for f, _ in found], pa.int64()) for c in _FEATURES}
            data["base_failed"] = pa.array([f["base_failed"] for f, _ in found], pa.bool_())
            data["pattern"] = pa.array([pattern_of(v) for _, v in found], pa.int32())
            yield pa.RecordBatch.from_pydict(data)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    measured = stage(rows.mapInArrow(run, f"doc_id long, {_SCHEMA}"), "quality")
    table = docs.sparkSession.createDataFrame(_model(measured.groupBy("pattern").count()), "pattern int, posterior double")
    out = measured.join(F.broadcast(table), "pattern", "left")
    return out.select("doc_id", *_FEATURES, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= keep_at)).alias("kept"), "posterior")
