"""Personal data: base patterns, and further spans by weak supervision.

Base spans are found by fixed patterns and always stay. Further candidates (numbers like cards without their check
digit, telephone numbers without a plus sign, written-out addresses, national ids, accounts, secrets, names) are voted
on by labelers: a regex labeler, gazetteer labelers and context labelers, each saying yes, no or nothing.
Expectation-maximisation over the counts of vote patterns, per kind and over all documents, estimates how reliable
each labeler is; its posteriors then train a logistic span classifier, which decides which candidates are added.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joulegrid.llm.common import batches, settle

#: Base kinds in the order of results, then the kinds that only the method adds.
KINDS = ("email", "ip", "card", "phone", "secret", "national", "account", "person")
BASE = 4

# A digit run is entered at its first digit only and quantifiers are possessive, so long runs take linear time; what
# matches is the same as with the plain patterns.
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

LOOSE_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\)|0?[0-9]{2,4})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
NATIONAL = re.compile(r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}+(?![A-Za-z0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+")
WRITTEN_AT = re.compile(r" ?[\[(]at[\])] ?")
WRITTEN_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++)++")
NAME = re.compile(r"\.? [A-ZÀ-Þ][a-zß-ÿ]+(?: [A-ZÀ-Þ][a-zß-ÿ]+)?")

#: Gazetteers.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
FIRST_NAMES = frozenset(
    """James Mary John Anna Robert Linda Michael Maria Peter Julia Thomas Laura William Elizabeth Richard Susan Joseph Jessica Charles Karen Daniel Nancy
    Matthew Lisa Anthony Margaret Mark Sandra Steven Ashley Andrew Emily George Donna Kenneth Michelle Kevin Carol Brian Amanda Edward Helen David Sarah Paul Emma
    Alice Henry Grace Jack Lucy Oliver Sophie Hans Greta Klaus Jürgen Ursula Wolfgang Monika Stefan Sabine Andreas Petra Dieter Renate Karl Ingrid Heike Uwe Birgit
    Jean Pierre Claire Louis Michel Marie Philippe Nathalie Alain Isabelle Jacques Sylvie Nicolas Camille Antoine Chloé François Hélène
    José Juan Carmen Luis Pablo Sofia Antonio Dolores Manuel Pilar Javier Lucía Miguel Teresa Carlos Rosa Pedro Elena Diego Marta""".split()
)
CUES = {
    "email": frozenset("mail email e-mail contact write".split()),
    "card": frozenset("card visa mastercard amex credit debit payment cc karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell telefon anruf tél teléfono".split()),
    "secret": frozenset("token secret password passwd key apikey api_key bearer pwd auth".split()),
    "national": frozenset("ssn social security insurance".split()),
    "account": frozenset("iban account bank konto compte cuenta".split()),
    "person": frozenset("name dear contact signed regards".split()),
}
AGAINST = frozenset("version isbn issn doi page chapter license licensed copyright commit sha".split())
TOKEN = re.compile(r"[^\W\d]+(?:[-_][^\W\d]+)*")
VOTERS = 5


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their at signs."""
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            last = found.end()
            yield begin, last
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def written_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with words for the at sign and the dots, found from the former."""
    last = 0
    for m in WRITTEN_AT.finditer(text):
        begin = m.start()
        while begin > last and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        found = WRITTEN_DOMAIN.match(text, m.end()) if begin < m.start() else None
        if found:
            last = found.end()
            yield begin, last


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) of base spans in order, and matches of the card pattern that fail."""
    spans = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    failed: list[tuple[int, int]] = []
    if DIGIT.search(text):
        spans += [(1, *m.span()) for m in IP.finditer(text) if all(map(small, m.group().split(".")))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, *m.span()))
            elif 13 <= len(digits) <= 19:
                failed.append(m.span())
        if "+" in text:
            spans += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    return spans, failed


def entropy(s: str) -> float:
    return -sum((n := s.count(c) / len(s)) * math.log2(n) for c in set(s)) if s else 0.0


def votes(kind: str, text: str, a: int, b: int) -> tuple[int, ...]:
    """What the labelers say of a candidate: 1 yes, 0 no, 2 nothing.

    In order: its shape (regex), its own characters against lists (gazetteer), cue words before it (gazetteer of
    contexts), the sign just before it (context), and how varied its characters are.
    """
    span, before = text[a:b], text[max(0, a - 40) : a]
    digits = sum(map(str.isdigit, span))
    near = [w.lower() for w in TOKEN.findall(before)][-4:]
    cue = 1 if any(w in CUES[kind] for w in near) else 0 if any(w in AGAINST for w in near) else 2
    sign = 1 if re.search(r"[:=#]\s?[\"']?\Z", before) else 2
    if kind == "card":
        shape = int(digits == 16 and re.fullmatch(r"[0-9]{16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}", span) is not None)
        listed = 1 if span[0] in "23456" else 0 if digits != 16 else 2
    elif kind == "secret":
        shape = int(re.fullmatch(r"[0-9a-fA-F]{32,}", span) is not None or (any(map(str.isupper, span)) and any(map(str.islower, span)) and digits >= 3))
        listed = 1 if re.match(r"(?i)(sk|pk|ghp|xox|akia)[-_]?", span) else 2
    elif kind == "phone":
        shape, listed = int(9 <= digits <= 12), 1 if "555" in span or span.startswith(("(", "0")) else 2
    elif kind == "person":
        words = span.replace(".", " ").split()
        shape, listed = int(len(words) >= 2), 1 if any(w in FIRST_NAMES for w in words) else 2
    elif kind == "national":
        shape, listed = int(span[:3] not in ("000", "666") and span[4:6] != "00"), 2 if span[0] != "9" else 0
    elif kind == "account":
        flat = span.replace(" ", "")
        shape = int(int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1)
        listed = 1 if flat[:2] in ("DE", "FR", "ES", "GB", "IT", "NL", "BE", "AT", "CH", "PT", "IE", "PL") else 0
    else:
        shape, listed = 1, 1 if re.search(r"(com|org|net|edu|de|fr|es|io)\Z", span) else 2
    spread = entropy(span)
    varied = 1 if spread >= 2.4 else 0 if spread < 1.5 else 2
    return shape, listed, cue, sign, varied


def candidates(text: str, failed: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    found = [("card", a, b) for a, b in failed]
    if DIGIT.search(text):
        for kind, pattern in (("phone", LOOSE_PHONE), ("national", NATIONAL), ("account", ACCOUNT)):
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
        found += [("secret", *m.span()) for m in SECRET.finditer(text) if DIGIT.search(m.group())]
    if "at]" in text or "at)" in text:
        found += [("email", a, b) for a, b in written_addresses(text)]
    for title in TITLES:
        at = text.find(title)
        while at >= 0:
            if (at == 0 or not text[at - 1].isalnum()) and (m := NAME.match(text, at + len(title))):
                found.append(("person", at, m.end()))
            at = text.find(title, at + 1)
    return found


def features(kind: str, ballot: tuple[int, ...], length: int, digits: int, spread: float) -> list[float]:
    return [
        1.0, *(float(kind == k) for k in KINDS), *(float(v == 1) for v in ballot), *(float(v == 0) for v in ballot),
        math.log1p(length) / 4, digits / max(1, length), spread / 4,
    ]


def describe(kind: str, text: str, a: int, b: int) -> tuple[tuple[int, ...], list[float]]:
    ballot = votes(kind, text, a, b)
    return ballot, features(kind, ballot, b - a, sum(map(str.isdigit, text[a:b])), entropy(text[a:b]))


@dataclass(frozen=True)
class Model:
    reliability: dict[str, list[tuple[float, float]]]  # by kind and labeler: P(yes | personal), P(yes | not)
    weights: np.ndarray


def estimate(patterns: list[tuple[str, str, int]], rounds: int = 50) -> tuple[dict[tuple[str, str], float], dict[str, list[tuple[float, float]]]]:
    """Expectation-maximisation over (kind, votes, count): P(personal) of each pattern, and the labelers' reliabilities.

    Labelers start better than chance, which fixes which side is which; pseudo-counts keep rare ones near there.
    """
    posterior: dict[tuple[str, str], float] = {}
    reliability: dict[str, list[tuple[float, float]]] = {}
    for kind in sorted({p[0] for p in patterns}):
        rows = [(p[1], p[2]) for p in patterns if p[0] == kind]
        ballots, n = np.array([list(map(int, r[0])) for r in rows]), np.array([r[1] for r in rows], float)
        yes, no, prior = np.full(VOTERS, 0.8), np.full(VOTERS, 0.2), 0.5
        for _ in range(rounds):
            good = np.log(prior) + np.where(ballots == 1, np.log(yes), np.where(ballots == 0, np.log1p(-yes), 0)).sum(axis=1)
            bad = np.log1p(-prior) + np.where(ballots == 1, np.log(no), np.where(ballots == 0, np.log1p(-no), 0)).sum(axis=1)
            q = 1 / (1 + np.exp(np.clip(bad - good, -50, 50)))
            cast = ballots < 2
            strength = 0.1 * n.sum() + 10  # pseudo-votes towards 0.8 and 0.2
            yes = ((n * q) @ (ballots == 1) + 0.8 * strength) / ((n * q) @ cast + strength)
            no = ((n * (1 - q)) @ (ballots == 1) + 0.2 * strength) / ((n * (1 - q)) @ cast + strength)
            prior = float(np.clip((n @ q + 5) / (n.sum() + 10), 0.02, 0.98))
        posterior |= {(kind, r[0]): float(x) for r, x in zip(rows, q, strict=True)}
        reliability[kind] = list(zip(yes.tolist(), no.tolist(), strict=True))
    return posterior, reliability


def fit_classifier(x: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on probabilities, by Newton steps; a row counts ``weight`` times."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (p - target)) + ridge * w)
    return w


def quotas(sizes: dict[str, int], most: int) -> dict[str, int]:
    """How many rows of each kind to take, about ``most`` in all: small kinds whole, the rest in equal parts."""
    out: dict[str, int] = {}
    for left, (kind, n) in zip(range(len(sizes), 0, -1), sorted(sizes.items(), key=lambda s: (s[1], s[0])), strict=True):
        out[kind] = min(n, max(1, (most - sum(out.values())) // left))
    return out


def rejecting(width: int) -> np.ndarray:
    """Weights under which no candidate is accepted, where there is nothing to learn from."""
    return np.array([-30.0] + [0.0] * (width - 1))


def train(docs: DataFrame, sample_rows: int = 20_000) -> Model:
    """Votes of all candidates of all documents, counted by pattern; the classifier sees all that differ, or about ``sample_rows``."""

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple[str, str, list[float]]] = []
            for text in b.column("text").to_pylist():
                if text:
                    for kind, a, z in candidates(text, base_spans(text)[1]):
                        ballot, f = describe(kind, text, a, z)
                        out.append((kind, "".join(map(str, ballot)), f))
            columns = zip(*out, strict=True) if out else ((), (), ())
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.list_(pa.float64())), strict=True)], ["kind", "votes", "features"])

        return work

    found = settle(batches(docs.select(F.col("text").cast("string")), make, "kind string, votes string, features array<double>", "text"))
    patterns = [(r["kind"], r["votes"], r["n"]) for r in found.groupBy("kind", "votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()]
    posterior, reliability = estimate(patterns)
    width = len(features("card", (2,) * VOTERS, 1, 0, 0.0))
    if not patterns:
        return Model({}, rejecting(width))
    # Equal candidates are one row that knows how many they are; the bound is on such rows, not on candidates.
    equal = settle(found.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")))
    sizes = {r["kind"]: r["count"] for r in equal.groupBy("kind").count().collect()}
    parts = 1_000_000
    taken = F.lit(False)
    for kind, most in quotas(sizes, sample_rows).items():
        share = parts if most >= sizes[kind] else max(1, parts * most // sizes[kind])
        taken = taken | ((F.col("kind") == kind) & (F.pmod(F.xxhash64("features", "votes"), F.lit(parts)) < share))
    rows = equal.where(taken).orderBy("kind", "votes", "features").collect()
    if not rows:
        return Model(reliability, rejecting(width))
    weight = np.sqrt([float(r["n"]) for r in rows])
    x = np.array([r["features"] for r in rows])
    target = np.array([posterior[(r["kind"], r["votes"])] for r in rows])
    return Model(reliability, fit_classifier(x, target, weight))


def spans(text: str | None, model: Model, threshold: float = 0.5) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: base ones and accepted candidates that overlap none before them, by kind and start."""
    if not text:
        return [], []
    base, failed = base_spans(text)
    base.sort()
    more = candidates(text, failed)
    if not more:
        return base, base
    # What is taken already, as disjoint stretches in order.
    begins: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    accepted = []
    for kind, a, b in sorted(more, key=lambda c: (KINDS.index(c[0]), c[1])):
        at = bisect_left(begins, b)
        if (at and ends[at - 1] > a) or 1 / (1 + math.exp(-float(np.dot(model.weights, describe(kind, text, a, b)[1])))) < threshold:
            continue
        accepted.append((KINDS.index(kind), a, b))
        begins.insert(at, a)
        ends.insert(at, b)
    return base, sorted(base + accepted)


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def find_personal_data(docs: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans. Null and empty texts have no span."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, **options))

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text in b.column("text").to_pylist():
                base, all_ = spans(text, held.value, threshold)
                out.append((*(sum(s[0] == k for s in base) for k in range(BASE)), hashlib.sha256(written(base).encode()).hexdigest(), written(all_)))
            columns = zip(*out, strict=True) if out else [()] * 6
            types = (*[pa.int64()] * 4, pa.string(), pa.string())
            return pa.record_batch([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

        return work

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, schema, "text")


def redact(docs: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and n_chars (if there) as long as the new text.

    Null and empty texts stay as they are, as do all other columns and the number of rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, **options))

    def cover(text: str | None) -> str | None:
        found = sorted((a, b, k) for k, a, b in spans(text, held.value, threshold)[1])
        if not found:
            return text
        out, at = [], 0
        for a, b, k in found:
            if a >= at:
                out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            before = b.column("text").to_pylist()
            after = [cover(t) for t in before]
            put = {"text": pa.array(after, b.column("text").type)}
            if "n_chars" in b.schema.names:
                kept = b.column("n_chars").to_pylist()
                put["n_chars"] = pa.array([n if x == y else len(y) for n, x, y in zip(kept, before, after, strict=True)], b.column("n_chars").type)
            return pa.record_batch([put.get(c, b.column(c)) for c in b.schema.names], b.schema.names)

        return work

    return batches(docs, make, docs.schema, "text")
