"""Personal data: base formats, and further spans chosen by boosted trees.

Generators with high recall propose overlapping spans (addresses with an at sign, runs of digits
with separators, long tokens of letters and digits, values behind an equals sign or colon). Features
describe a span's format and the words around it. Trees boosted on a bounded sample score each span;
its threshold is calibrated on sampled documents kept out of the fit. Spans that match a base format
are always kept.

Spans of base format stay whatever the trees say, so the trees are taught on the rest. Labels of the
sample come from context and from relaxed formats: a proposal is personal when the words before it name
its kind, when it is a key with a known prefix or the value of a password, token or secret, and when it
stands where a base span stood whose plus sign, separators, length or letters were altered. Dates, bare
numbers and wrong check digits in the same places are taught as not personal.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm.boosting import Boosted
from quillwork.llm.common import bounded_sample, slices, text_list
from quillwork.llm.registry import llm_query
from quillwork.sources.tables import table

#: Documents whose spans the trees are fitted on; their ids are drawn by hash.
SAMPLE_DOCUMENTS = 4_000
#: Spans taken from the sample at most.
SAMPLE_SPANS = 40_000
#: Spans whose features are held together.
SCORED_AT_ONCE = 4096
#: Share of chosen spans that has to be right on the documents kept out.
PRECISION = 0.95

KINDS = ("email", "ip", "card", "phone", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its first digit only: from a later one the same would follow
_EDGES = ".,;:!?()[]{}<>\"'"
_WIDE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|[.-])[0-9]{1,3}){3}(?![0-9])")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_DIGITS = re.compile(r"[+(]?[0-9](?:[ ().-]{0,3}[0-9]){6,}")
_TOKEN = re.compile(r"[A-Za-z0-9_/+=-]{16,}+")
_VALUE = re.compile(r"(?<=[=:])[^\s=:,;\"']{6,}+")
_NUMBER = re.compile(r"[0-9]+")
_KEY = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|(?:gh[pousr]_|sk-|xox[abp]-)[0-9A-Za-z-]{16,}")
_NAMED = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api_?key)\s*[=:]\s*[\"']?$")

_HINTS = (
    re.compile(r"(?i)mail|contact|write"),
    re.compile(r"(?i)phone|call|tel|mobile|fax"),
    re.compile(r"(?i)card|visa|iban|account"),
    re.compile(r"(?i)\bip\b|host|address|server"),
    re.compile(r"(?i)pass|key|secret|token|pwd"),
)

# the words that name a kind, at most two words before the value
_CONTEXT = {
    kind: re.compile(rf"(?i)\b(?:{words})\b\W*(?:\w+\W+){{0,2}}$")
    for kind, words in (
        ("email", "e-?mail|mail|contact|write"),
        ("phone", "phone|telephone|call|tel|mobile|cell|fax"),
        ("card", "card|visa|mastercard|amex"),
        ("ip", "ip|host|server"),
    )
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base formats, by kind and start; offsets are code points."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            found.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans that may be personal, with the kind they would be, without those of base format."""
    found = set()
    if "@" in text:
        end = 0
        while (at := text.find("@", end)) >= 0:
            left, right = at, at + 1
            while left > end and not text[left - 1].isspace():
                left -= 1
            while right < len(text) and not text[right].isspace():
                right += 1
            end = right
            while left < at and text[left] in _EDGES:
                left += 1
            while right > at + 1 and text[right - 1] in _EDGES:
                right -= 1
            if left < at and right > at + 1:
                found.add(("email", left, right))
    for m in _DIGITS.finditer(text):
        digits = sum(c.isdigit() for c in m[0])
        found.add(("card" if digits > 12 else "phone", m.start(), m.end()))
    for pattern in (_IP, _WIDE_IP):
        found.update(("ip", m.start(), m.end()) for m in pattern.finditer(text))
    place = 0
    for word in text.split():
        if len(word) >= 8 and not word.isalpha():
            place = text.find(word, place)
            for pattern in (_TOKEN, _VALUE):
                for m in pattern.finditer(word):
                    if any(c.isdigit() for c in m[0]):
                        found.add(("secret", place + m.start(), place + m.end()))
            place += len(word)
    return sorted(found, key=lambda s: (s[1], s[2], s[0]))


def features(text: str, span: tuple[str, int, int]) -> list[float]:
    kind, start, end = span
    body, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 1]
    digits = [c for c in body if c.isdigit()]
    letters = sum(c.isalpha() for c in body)
    counts: dict[str, int] = {}
    for c in body:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(n / len(body) * math.log2(n / len(body)) for n in counts.values())
    parts = body.split(".")
    return [
        float(KINDS.index(kind)), float(len(body)), float(len(digits)), float(letters),
        float(sum(c.isupper() for c in body)), float(len(body) - len(digits) - letters), entropy,
        float(body.count("@")), float(body.count(".")), float(body.count(" ")), float(body.count("-")),
        float("(" in body),
        float(luhn("".join(c for c in digits if c in "0123456789"))) if digits else 0.0,
        float(max((int(p[:4]) for p in _NUMBER.findall(body)), default=0)), float(len(parts)),
        float(len(parts[-1])), float(before[-1:].isalnum()), float(before.rstrip(" \"'")[-1:] in ("=", ":")),
        float(after.isalnum()), float(after in (".", ",", "")), float(body[:4].isupper() and body[:4].isalpha()),
        float(all(c in "0123456789abcdef" for c in body)),
        *(float(bool(h.search(before))) for h in _HINTS),
    ]


def weak_label(text: str, span: tuple[str, int, int]) -> int:
    """1 where the words before a proposal, or its own format, say that it is personal."""
    kind, start, end = span
    body, before = text[start:end], text[max(0, start - 32) : start]
    if kind == "secret":
        return int(bool(_KEY.fullmatch(body)) or bool(_NAMED.search(before)))
    if kind == "card" and not luhn("".join(c for c in body if c in "0123456789")):
        return 0
    if kind == "ip" and any(int(p[:4]) > 255 for p in _NUMBER.findall(body)):
        return 0
    return int(bool(_CONTEXT[kind].search(before)))


def variants(kind: str, body: str) -> list[tuple[str, str, int]]:
    """(words before, form, label): a base span's value in forms that the base formats miss, and values that are not personal."""
    digits = "".join(c for c in body if c in "0123456789")
    if kind == "phone":
        n = digits[-10:] if len(digits) > 10 else digits
        a, b, c = n[:-7] or n[:3], n[-7:-4], n[-4:]
        plain = [("", f"{c[:2]}{n}"[:k], 0) for k in (7, 8, 10, 12)]
        dates = [("", f"19{c[:2]} - 20{c[2:]}", 0), ("", f"20{c[:2]}-0{b[0]}-1{b[1]}", 0), ("", f"1{b[1]}.0{b[0]}.20{c[:2]}", 0)]
        forms = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{a} {b}{c}", f"00{digits}"[:14]]
        named = [("call ", f) for f in forms] + [("phone: ", f) for f in (*forms, n, f"{b}-{c}")] + [("call us on ", n)]
        return [*[("", f, 1) for f in forms[:2]], *[(w, f, 1) for w, f in named], *plain, *dates]
    if kind == "card":
        n, wrong = sorted((f"{digits[:14]}{d}" for d in range(10)), key=lambda x: not luhn(x))[:2]
        forms = [lambda n: n, lambda n: f"{n[:4]} {n[4:10]} {n[10:]}", lambda n: f"{n[:4]}-{n[4:10]}-{n[10:]}"]
        dotted = ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
        good = [(w, f(n), 1) for w in ("", "card ") for f in forms] + [("", dotted, 1), ("card ", dotted, 1)]
        return good + [(w, f(wrong), 0) for w in ("", "card ", "order ") for f in forms]
    if kind == "ip":
        forms = [body.replace(".", "[.]"), body.replace(".", "(.)")]
        dashed, high = body.replace(".", "-"), ".".join(str(int(p[-3:]) + 256) for p in body.split("."))
        good = [(w, f, 1) for w in ("", "host ") for f in forms] + [("host ", dashed, 1), ("ip ", dashed, 1)]
        return good + [("", dashed, 0), ("", high, 0), ("host ", high, 0), ("ip ", high.replace(".", "[.]"), 0)]
    name, host = body.split("@", 1)
    short = f"{name}@{host.split('.')[0]}"
    good = [(w, f, 1) for w in ("", "mail ") for f in (f"{name}\u00e9@{host}", f"{name}@\u00fc{host}")]
    return [*good, ("mail ", short, 1), ("contact: ", short, 1), ("", short, 0), ("", f"{len(name)}@{len(host)}.50", 0), ("", f"@{host}@", 0)]


def taught(text: str) -> list[tuple[int, list[float]]]:
    """(label, features) of a text's proposals apart from base spans, and of the altered forms of each base span."""
    base, out = base_spans(text), []
    covered = sorted((s, e) for _, s, e in base)
    at, reach = 0, 0  # proposals come by start; reach is the furthest end of the base spans that begin before one's end
    for span in proposals(text):
        while at < len(covered) and covered[at][0] < span[1]:
            reach, at = max(reach, covered[at][1]), at + 1
        if reach <= span[1] and not (at < len(covered) and covered[at][0] < span[2]):
            out.append((weak_label(text, span), features(text, span)))
    for kind, start, end in base:
        after = text[end : end + 64]
        for words, form, label in variants(kind, text[start:end]):
            before = text[max(0, start - 64) : start] + words
            near, stop = before + form + after, len(before) + len(form)
            kept = base_spans(near)
            for k, s, e in proposals(near):
                if s < stop and len(before) < e and not any(s < y and x < e for _, x, y in kept):
                    whole = k == kind and s >= len(before) and e <= stop
                    out.append((label if whole else 0, features(near, (k, s, e))))
    return out


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", documents: int = SAMPLE_DOCUMENTS,
        precision: float = PRECISION) -> Boosted | None:
    """Trees fitted on proposals and altered base spans from at most ``documents`` documents; None where there is one class only.

    A quarter of the sampled documents, by hash, calibrates the threshold. Spans are drawn by the hash of their
    document and place, so that equal ones weigh as much as they occur.
    """
    sample = bounded_sample(docs.select(doc_id), doc_id, documents)
    width = len(features("a1", ("secret", 0, 2)))
    schema = pa.schema([("h", pa.int64()), ("place", pa.int64()), ("held", pa.bool_()), ("y", pa.int32()), ("x", pa.list_(pa.float64()))])

    def describe(batches):
        for batch in slices(batches):
            for body, out, h in zip(text_list(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                rows = [(h, place, out, label, row) for place, (label, row) in enumerate(taught(body))]
                for at in range(0, len(rows), SCORED_AT_ONCE):
                    columns = zip(*rows[at : at + SCORED_AT_ONCE])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    rows = (
        docs.join(F.broadcast(sample), doc_id, "left_semi")
        .select(F.col(text).cast("string").alias("_t"), (F.pmod(F.xxhash64(doc_id, F.lit(7)), F.lit(4)) == 0).alias("_h"), F.xxhash64(doc_id).alias("_d"))
        .mapInArrow(describe, "h long, place long, held boolean, y int, x array<double>")
        .orderBy(F.xxhash64("h", "place"), "h", "place", "x", "y")
        .limit(SAMPLE_SPANS)
        .select("held", "y", "x")
        .toPandas()
    )
    held, y = rows["held"].to_numpy(bool), rows["y"].to_numpy(int)
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, width)
    if min(y[~held].sum(), (1 - y[~held]).sum()) == 0:
        return None
    model = Boosted().fit(x[~held], y[~held])
    return model.calibrate(x[held], y[held], precision) if 0 < y[held].sum() < held.sum() else model


def find_spans(text: str, model: Boosted | None) -> tuple[list, list]:
    """(base spans, all spans): chosen proposals are added unless a span already covers them."""
    base = base_spans(text)
    if model is None:
        return base, base
    known = set(base)
    spans = [s for s in proposals(text) if s not in known]
    scores: list[float] = []
    for at in range(0, len(spans), SCORED_AT_ONCE):
        scores += model.probability(np.array([features(text, s) for s in spans[at : at + SCORED_AT_ONCE]])).tolist()
    covered = bytearray(len(text))  # a mark a character, so what overlaps is found in a span's own length
    for _, start, end in base:
        covered[start:end] = b"\x01" * (end - start)
    taken = list(base)
    for score, (kind, start, end) in sorted(zip(scores, spans), key=lambda s: (-s[0], s[1])):
        if score >= model.threshold and covered.find(1, start, end) < 0:
            covered[start:end] = b"\x01" * (end - start)
            taken.append((kind, start, end))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(taken, key=lambda s: (order[s[0]], s[1]))


def private_spans(docs: DataFrame, model: Boosted | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, spans``: arrays of (kind, start, end) for every row; a null text has none.

    Repeated rows are answered each; null ids stay null; an empty table gives no rows.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(kind)), ("spans", pa.list_(kind))])

    def find(batches):
        for batch in slices(batches):
            out = [find_spans(t, model) for t in text_list(batch.column(1))]
            named = [[[dict(zip(("kind", "start", "end"), s)) for s in side] for side in row] for row in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n[0] for n in named], schema.field(1).type),
                 pa.array([n[1] for n in named], schema.field(2).type)], schema=schema)

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    return rows.mapInArrow(find, f"doc_id long, base {span}, spans {span}")


def redact(docs: DataFrame, model: Boosted | None, text: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by ``<KIND>``; all other columns stay, null texts stay null."""
    place = docs.columns.index(text)

    def mask(batches):
        for batch in slices(batches):
            out = []
            for body in batch.column(place).to_pylist():
                if body:
                    # spans never overlap after the base ones are merged, so they are replaced from the end
                    spans = sorted(find_spans(body, model)[1], key=lambda s: (s[1], -s[2]))
                    parts, end = [], 0
                    for kind, start, stop in spans:
                        if start >= end:
                            parts += [body[end:start], f"<{kind.upper()}>"]
                        elif stop <= end:
                            continue
                        end = max(end, stop)
                    body = "".join(parts) + body[end:]
                out.append(body)
            columns = list(batch.columns)
            columns[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(mask, docs.schema)


def joined(spans: str) -> F.Column:
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@llm_query("op5_private_data")
def op5_private_data(spark, sf):
    """Spans of personal data in every whole text of documents."""
    docs = table(spark, sf, "documents")
    found = private_spans(docs, fit(docs))

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[number(k) for k in ("email", "ip", "card", "phone")],
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )
