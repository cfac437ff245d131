"""Personal data: fixed patterns, and a linear-chain CRF over word shapes for what they miss.

The fixed patterns find e-mail addresses, IP addresses, payment cards and phone
numbers.  A conditional random field, trained here from a small labelled table,
then reads the runs of tokens near a digit, an ``@``, a bracket or the words of a
spelled-out address (no personal number or address is anywhere else) and may add
spans that the patterns miss, such as ``jane [at] mail [dot] org``,
``sales at example dot com``, ``4111.1111.1111.1111`` or ``tel. 555-010-9999``.
An added span never touches a fixed one, and has to be possible for its kind
(digit counts, Luhn sum, address parts), so ordinary text is left alone.

Features of a token are its shape, the shapes around it, its digit count, the words
``at`` and ``dot`` around it and, if training has seen it, the word itself.  Decoding is Viterbi over all runs of an
Arrow batch at once, in numpy.

Edge cases: a null text counts as empty and has no spans; texts of any length
are read whole, in linear time; offsets are code points, ends exclusive;
repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

KINDS = ("email", "ip", "card", "phone")

Span = tuple[str, int, int]

# -- fixed patterns --------------------------------------------------------------

LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
DOTTED_DIGITS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """Whether the Luhn sum of a string of digits ends in zero."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_PART:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield "email", start, end
        else:
            end = at + 1  # no match starts in what stands before this sign
        at = text.find("@", end)


def _ips(text: str) -> Iterator[Span]:
    for chain in DOTTED_DIGITS.finditer(text):
        parts = list(DIGITS.finditer(text, chain.start(), chain.end()))
        for i in range(0, len(parts) - 3, 4):
            four = [p.group().lstrip("0") for p in parts[i : i + 4]]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in four):
                yield "ip", parts[i].start(), parts[i + 3].end()


def _digits(text: str) -> str:
    return "".join(DIGITS.findall(text))


def _cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()


def _phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            yield "phone", m.start(), m.end()


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and start: leftmost, not overlapping within a kind."""
    spans: list[Span] = []
    if "@" in text:
        spans += _emails(text)
    if DIGIT.search(text):
        spans += _ips(text)
        spans += _cards(text)
        if "+" in text:
            spans += _phones(text)
    return spans


# -- labelled table ----------------------------------------------------------------

#: Lines to learn from, with the kind of personal data marked as <kind>...</kind>.
#: Digits are varied by :func:`labelled_lines`.
LABELLED = """
Please write to <email>jane.doe@example.org</email> for details
mail <email>support@mail.example.com</email> or call
contact <email>jane [at] example [dot] org</email> today
reach me: <email>john (at) corp (dot) net</email> thanks
address <email>sales at example dot com</email>
write <email>bob_smith @ example.com</email> please
The server <ip>192.168.1.20</ip> did not answer
connect from <ip>10.0.12.7</ip> to <ip>172.16.0.4</ip> failed
host <ip>203.0.113.9</ip>, port 8080
ip <ip>198.51.100.23</ip>: refused
His card <card>4111111111111111</card> was used
card number <card>4111 1111 1111 1111</card> expires 12/27
pay with <card>5500-0000-0000-0004</card> now
visa <card>4111.1111.1111.1111</card> declined
card <card>4111/1111/1111/1111</card> and
paid by <card>340000000000009</card> yesterday
Call <phone>+1 (555) 010-9999</phone> after nine
phone <phone>+44 20 7946 0018</phone> or
tel. <phone>555-010-9999</phone> until five
call me at <phone>(555) 010-9999</phone> please
mobile: <phone>0171 5550199</phone> evenings
phone: <phone>555.010.9999</phone> today
fax <phone>+49-30-5550199</phone> office
tel <phone>(030) 555 01 99</phone> now
In 2021 the price was 1500 and rose by 12 percent
chapter 12, pages 101-140, volume 3
version 1.2.3 of 10.04.2019 and 2.0.1
order 20190412331 has 4 items at 19.99 each
Total 1,234,567.89 in 365 days
token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end
id 9999888877776666555544 and 12345678
isbn 978-3-16-148410-0 printed in 1999
at 10:45 on 2023-11-05 we met
see section 3.4.5.6.7 for 250 more
follow @someone and @other on it
the ratio 3/4 and 0.75 is the same
temperature -12.5 to +30 in 24 h
build 1.0.0.4096 commit 7f3a9c2b1d
of the 17 and a 3 er on 1200 thing
1 2 3 4 5 6 7 8 9 10 11 12
serial 4000123412341234567890123 ok
in 555 of 1000 cases 010 or 9999 were
<email>info at example dot com</email> is read every day
write to <email>jane.doe at mail dot example dot org</email> about it
Contact <email>bob_smith at corp dot net</email>.
mail <email>kim at example dot co dot uk</email> or ask
send it to <email>help at shop dot example dot io</email> please
reply to <email>Max.Muster at firma dot de</email> soon
<email>post at example dot com</email> or <email>desk at example dot com</email>
bitte an <email>team-nord at mein-shop dot ch</email> schreiben
mine is <email>kim42 at post dot me</email> since then
ask <email>dev-ops at ci dot acme dot eu</email>!
she looked at one dot and smiled
the point at the dot on the map
we met at the dot com era and left
he pointed at a dot near the edge
stare at that dot until it moves
put it at every dot in the row
see us at www.example.com today
look at example.com for more
we arrived at noon.Then we left
""".strip().splitlines()

MARK = re.compile(r"<(/?)(\w+)>")


def labelled_lines(copies: int = 6) -> list[tuple[str, list[Span]]]:
    """The labelled table: every line as it is and with its digits changed by a rule."""
    table = []
    for line in LABELLED:
        for copy in range(copies):
            text, spans, kind, at = "", [], "", 0
            for m in MARK.finditer(line):
                text += line[at : m.start()]
                if m[1]:
                    spans.append((kind, start, len(text)))
                else:
                    kind, start = m[2], len(text)
                at = m.end()
            text += line[at:]
            varied = "".join(str((int(c) + copy * (i % 7 + 1)) % 10) if "0" <= c <= "9" else c for i, c in enumerate(text))
            table.append((varied, spans))
    return table


# -- features ------------------------------------------------------------------------

TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_|[^\S\n]+|\n|\w")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

#: Words that stand for the signs of an address.
SIGN_WORDS = {"at": "@", "dot": "."}

#: Tokens on either side of an anchor that the field reads.
REACH = 8


def tokens_of(text: str, start: int = 0, end: int | None = None) -> list[tuple[str, int, int]]:
    """Words, digit runs and signs with their places; white space only separates."""
    return [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(text, start, len(text) if end is None else end)
            if not m.group().isspace()]


def shape(token: str) -> str:
    """d with the count of digits, X or x for words (x for ``at`` and ``dot``), the sign itself otherwise."""
    if "0" <= token[0] <= "9":
        return f"d{min(len(token), 20)}"
    if token.lower() in SIGN_WORDS:
        return "x"
    if token[0].isalpha():
        return ("X" if token[0].isupper() else "x") + ("" if len(token) > 1 else "1")
    return token


def features(tokens: Sequence[tuple[str, int, int]]) -> list[list[str]]:
    """Names of the features of every token of a run."""
    shapes = ["^", "^", *(shape(t) for t, _, _ in tokens), "$", "$"]
    glued = [False, *(a[2] == b[1] for a, b in zip(tokens, tokens[1:])), False]
    signs = "--" + "".join(SIGN_WORDS.get(t.lower(), "-") for t, _, _ in tokens) + "--"
    out = []
    for i, (token, _, _) in enumerate(tokens):
        s = shapes[i : i + 5]
        out.append([f"s={s[2]}", f"-1={s[1]}", f"+1={s[3]}", f"-1s={s[1]}{s[2]}", f"+1s={s[2]}{s[3]}",
                    f"-2={s[0]}{s[1]}{s[2]}", f"+2={s[2]}{s[3]}{s[4]}", f"g={glued[i]}{glued[i + 1]}{s[2]}",
                    f"w={token.lower()}", f"a={signs[i : i + 5]}"])
    return out


def spelled(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Places of addresses in words within a line: the local part, ``at`` and the domain."""
    places, stop = [], start
    for m in SPELLED.finditer(text, start, end):
        begin = m.start()
        while begin > stop and text[begin - 1].isspace():
            begin -= 1
        while begin > stop and text[begin - 1] in LOCAL_PART:
            begin -= 1
        stop = m.end()
        places.append((begin, stop))
    return places


def runs(text: str) -> list[list[tuple[str, int, int]]]:
    """Runs of tokens at most ``REACH`` tokens from an anchor, in order, within lines.

    Anchors are digits, signs of :data:`ANCHOR` and every token of an address in words.
    """
    found = []
    sign, words = ANCHOR.search(text), SPELLED.search(text)
    while sign or words:
        at = min(m.start() for m in (sign, words) if m)
        start = text.rfind("\n", 0, at) + 1
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        tokens = tokens_of(text, start, end)
        places = spelled(text, start, end) if words and words.start() < end else []
        low = last = -1
        k = 0
        for i, (t, a, _) in enumerate(tokens):
            while k < len(places) and places[k][1] <= a:
                k += 1
            if ANCHOR.match(t) or k < len(places) and places[k][0] <= a:
                if low >= 0 and i - REACH <= last:
                    last = i + REACH
                else:
                    if low >= 0:
                        found.append(tokens[low : last + 1])
                    low, last = max(i - REACH, 0), i + REACH
        found.append(tokens[low : last + 1])
        sign = ANCHOR.search(text, end) if sign and sign.start() < end else sign
        words = SPELLED.search(text, end) if words and words.start() < end else words
    return found


#: What a run of tokens is around: a digit, an @ or the bracket of a word that stands for it,
ANCHOR = re.compile(r"[0-9@\[(]")

#: or the words of an address without signs, from ``at`` to the end of the domain.
SPELLED = re.compile(r"(?<=[A-Za-z0-9._%+-][^\S\n])at[^\S\n]{1,2}[A-Za-z0-9-]+(?:(?:\.|[^\S\n]dot[^\S\n])[A-Za-z0-9-]+)+"
                     r"|(?<=[A-Za-z0-9._%+-][^\S\n]{2})at[^\S\n]{1,2}[A-Za-z0-9-]+(?:(?:\.|[^\S\n]dot[^\S\n])[A-Za-z0-9-]+)+",
                     re.IGNORECASE)


# -- the field ---------------------------------------------------------------------------


@dataclass
class Field:
    """Weights of a linear-chain CRF."""

    index: dict[str, int]
    emit: np.ndarray  # features x labels; the last row is for unknown features
    step: np.ndarray  # label to label
    begin: np.ndarray  # first label

    def matrix(self, sequences: Sequence[Sequence[tuple[str, int, int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Padded label scores (sequence, place, label) and lengths."""
        lengths = np.array([len(s) for s in sequences])
        unknown = len(self.index)
        rows = [[self.index.get(f, unknown) for f in fs] for s in sequences for fs in features(s)]
        flat = self.emit[np.array(rows, dtype=np.int64)].sum(axis=1)
        scores = np.zeros((len(sequences), lengths.max(), len(LABELS)))
        scores[np.arange(lengths.max()) < lengths[:, None]] = flat
        return scores, lengths

    def decode(self, sequences: Sequence[Sequence[tuple[str, int, int]]]) -> list[np.ndarray]:
        """Best labels of each sequence: Viterbi over all of them at once."""
        if not sequences:
            return []
        scores, lengths = self.matrix(sequences)
        n, longest, _ = scores.shape
        best = scores[:, 0] + self.begin
        back = np.zeros(scores.shape, dtype=np.int8)
        for t in range(1, longest):
            paths = best[:, :, None] + self.step
            back[:, t] = paths.argmax(axis=1)
            best = np.where((t < lengths)[:, None], paths.max(axis=1) + scores[:, t], best)
        labels = np.zeros((n, longest), dtype=np.int8)
        now = best.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            labels[:, t] = now
            now = np.where((t < lengths) & (t > 0), back[np.arange(n), t, now], now)
        return [labels[i, :k] for i, k in enumerate(lengths)]


def _normal(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(table: Sequence[tuple[str, list[Span]]] | None = None, rounds: int = 120, ridge: float = 0.02,
          rate: float = 0.15) -> Field:
    """Fit by maximum likelihood (forward-backward, Adam) on (text, spans) rows; the labelled table by default."""
    table = labelled_lines() if table is None else table
    sequences, gold = [], []
    for text, spans in table:
        tokens = tokens_of(text)
        labels = np.zeros(len(tokens), dtype=np.int64)
        for kind, start, end in spans:
            inside = [i for i, (_, a, b) in enumerate(tokens) if a >= start and b <= end]
            labels[inside] = LABELS.index(f"I-{kind}")
            labels[inside[0]] = LABELS.index(f"B-{kind}")
        sequences.append(tokens)
        gold.append(labels)
    names = sorted({f for s in sequences for fs in features(s) for f in fs})
    field = Field({f: i for i, f in enumerate(names)}, np.zeros((len(names) + 1, len(LABELS))),
                  np.zeros((len(LABELS), len(LABELS))), np.zeros(len(LABELS)))
    n, m = len(sequences), len(LABELS)
    lengths = np.array([len(s) for s in sequences])
    longest = lengths.max()
    inside = np.arange(longest) < lengths[:, None]
    rows = np.array([[field.index[f] for f in fs] for s in sequences for fs in features(s)])
    flat_gold = np.concatenate(gold)
    padded = np.zeros((n, longest), dtype=np.int64)
    padded[inside] = flat_gold
    seen_step = np.zeros((m, m))
    both = inside[:, 1:]
    np.add.at(seen_step, (padded[:, :-1][both], padded[:, 1:][both]), 1)
    weights = [field.emit, field.step, field.begin]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for turn in range(1, rounds + 1):
        scores, _ = field.matrix(sequences)
        alpha = np.zeros(scores.shape)
        alpha[:, 0] = scores[:, 0] + field.begin
        for t in range(1, longest):
            alpha[:, t] = _normal(alpha[:, t - 1, :, None] + field.step, 1) + scores[:, t]
        beta = np.zeros(scores.shape)
        for t in range(longest - 2, -1, -1):
            ahead = _normal(field.step + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where((t + 1 < lengths)[:, None], ahead, 0.0)
        total = _normal(alpha[np.arange(n), lengths - 1], 1)
        belief = np.exp(alpha + beta - total[:, None, None])
        surplus = belief[inside]
        surplus[np.arange(len(flat_gold)), flat_gold] -= 1
        emit = np.zeros_like(field.emit)
        np.add.at(emit, rows.ravel(), np.repeat(surplus, rows.shape[1], axis=0))
        step = -seen_step
        for t in range(longest - 1):
            of = t + 1 < lengths
            step += np.exp(alpha[of, t, :, None] + field.step + (scores[of, t + 1] + beta[of, t + 1])[:, None, :]
                           - total[of, None, None]).sum(axis=0)
        begin = belief[:, 0].sum(axis=0) - np.bincount(padded[:, 0], minlength=m)
        for k, slope in enumerate((emit, step, begin)):
            slope = slope / n + ridge / n * weights[k]
            first[k] += 0.1 * (slope - first[k])
            second[k] += 0.001 * (slope**2 - second[k])
            weights[k] -= rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)
    # a span begins with B and goes on with I of its kind
    for j, label in enumerate(LABELS):
        if label[0] == "I":
            field.begin[j] = -1e4
            for i, before in enumerate(LABELS):
                if before[2:] != label[2:]:
                    field.step[i, j] = -1e4
    field.emit[-1] = 0
    return field


#: What an added span has to look like as a whole.
LOOKS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+\s?(?:@|\[at\]|\(at\)|\sat\s)\s?[A-Za-z0-9-]+"
                        r"(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)[A-Za-z0-9-]+)+", re.IGNORECASE),
    "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[ ./-]?[0-9]){12,18}"),
    "phone": re.compile(r"[+(]?[0-9](?:[ ()./-]{0,2}[0-9]){8,14}"),
}


def possible(kind: str, found: str) -> bool:
    """Whether a text can be what the field takes it for."""
    if not LOOKS[kind].fullmatch(found):
        return False
    digits = _digits(found)
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return digits != found
    return kind != "ip" or all(int(p) <= 255 for p in DIGITS.findall(found))


def spans_of(texts: Sequence[str], field: Field, cells: int = 400_000) -> list[list[Span]]:
    """All spans of each text by kind and start: fixed ones, and those that the field adds."""
    fixed = [base_spans(t) for t in texts]
    work = [(i, run) for i, t in enumerate(texts) for run in runs(t)]
    work.sort(key=lambda x: len(x[1]))
    added: list[list[Span]] = [[] for _ in texts]
    at = 0
    while at < len(work):
        stop = at + 1
        while stop < len(work) and (stop - at) * len(work[stop][1]) < cells:
            stop += 1
        part = work[at:stop]
        for (i, run), labels in zip(part, field.decode([run for _, run in part])):
            if not labels.any():
                continue
            begin = None
            for j in range(len(run) + 1):
                label = LABELS[labels[j]] if j < len(run) else "O"
                if begin is not None and label[0] != "I":
                    kind, start, end = LABELS[labels[begin]][2:], run[begin][1], run[j - 1][2]
                    free = all(end <= a or start >= b for _, a, b in fixed[i])
                    if free and possible(kind, texts[i][start:end]):
                        added[i].append((kind, start, end))
                    begin = None
                if label[0] == "B":
                    begin = j
        at = stop
    place = {k: i for i, k in enumerate(KINDS)}
    return [sorted({*a, *b}, key=lambda s: (place[s[0]], s[1], s[2])) for a, b in zip(fixed, added)]


def written(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# -- Spark -------------------------------------------------------------------------------

SPAN_TYPE = "array<struct<kind: string, start: int, stop: int, base: boolean>>"


def find_spans(text: Column, shared_field) -> Column:
    """All spans of a text column; ``base`` marks those of the fixed patterns."""

    @F.pandas_udf(SPAN_TYPE)
    def pii_spans(texts: pd.Series) -> pd.Series:
        values = [t if isinstance(t, str) else "" for t in texts]
        out: list[list[dict]] = []
        for start in range(0, len(values), 500):
            part = values[start : start + 500]
            for t, spans in zip(part, spans_of(part, shared_field.value)):
                fixed = set(base_spans(t)) if spans else ()
                out.append([{"kind": k, "start": a, "stop": b, "base": (k, a, b) in fixed} for k, a, b in spans])
        return pd.Series(out)

    return pii_spans(text)


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with a column ``pii_spans`` (array of kind, start, stop, base)."""
    spark = docs.sparkSession
    ship(spark)
    shared_field = spark.sparkContext.broadcast(train() if field is None else field)
    return docs.withColumn("pii_spans", find_spans(F.coalesce(F.col("text"), F.lit("")), shared_field))


def replaced(text: str, spans: Sequence[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become the first one's."""
    parts, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with all personal data in ``text`` replaced by its kind (null stays null), in one pass."""
    spark = docs.sparkSession
    ship(spark)
    shared_field = spark.sparkContext.broadcast(train() if field is None else field)

    @F.arrow_udf("string")
    def redacted(texts: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for start in range(0, len(texts), 500):
            part = texts.slice(start, 500).to_pylist()
            for t, spans in zip(part, spans_of([t or "" for t in part], shared_field.value)):
                out.append(replaced(t, spans) if spans else t)
        return pa.array(out, pa.string())

    return docs.withColumn("text", redacted(F.col("text")))


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the fixed spans, the digest of those spans and all spans as text, per row of ``docs``."""
    spans = F.col("pii_spans")
    as_text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    fixed = F.filter(spans, lambda s: s["base"])
    base_text = F.array_join(F.transform(fixed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(fixed, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = personal_data(docs.select("doc_id", "text")).select("doc_id", "pii_spans")
    return found.select("doc_id", *map(count, KINDS), F.sha2(base_text, 256).alias("base_sha256"), as_text.alias("spans"),
                        (F.size(spans) - F.size(fixed)).cast("long").alias("n_added"))
