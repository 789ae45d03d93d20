"""Personal data by fixed patterns and a skip-chain conditional random field.

Four kinds: email, ip, card and phone. The base patterns are searched over the whole text, leftmost without overlaps, each kind for itself; a match that
fails its test is dropped as a whole. That loses a phone number that runs on into an address, a card number with a number behind it, and a second
mention in another form. The field finds these: its nodes are the tokens that hold a digit or an @, labelled with a kind or with nothing.

- Node potentials: weights of what a token looks like (digits, groups, checksum, quad, mail form) and of the run of tokens it is in.
- Chain potentials between neighbouring tokens; words without digits are known to be nothing, so a run borders on nothing at its ends.
- Skip potentials between each token and its next mention anywhere in the document: the same token, or one with the same last seven
  digits. Mentions are linked in their order, so edges grow with tokens, not with pairs.

Labels of all nodes are inferred by loopy belief propagation over chain and skip edges together, until messages settle (at most `ROUNDS` rounds); what the
base has found is evidence (`KNOWN`). Runs of a kind with marginals of `SURE` or more that pass the kind's own test and meet no base span are added. Base spans always stay.

The weights are fitted by pseudo-likelihood to the labels that base spans give, on at most some 2 x `sample_rows` different documents with nodes, a window
of at most `SAMPLE_NODES` nodes of each (both chosen by hash), and to examples made from them: a found span followed far behind by another form of it
(labelled like it), the same form alone (nothing), a span that runs on into a number (labelled as before), dates and numbers, alone and repeated (nothing).
In half of the nodes of each step what the run tells is withheld. So skip edges carry weight, and a bare number is taken for a phone only with reason.

A text is scanned once; base spans and nodes are written, and fitted and labelled from there. Nothing is shuffled but the different
nodes of documents for the sample. Defined results: a null or empty text has no spans. Repeated rows are labelled one by one, alike. Without any base
span the field adds nothing. Places are code points. An empty table gives no rows. A column whose name clashes with a new one gives way to it.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from colloquy.llm.shared import written
from colloquy.llm.texts import map_texts, parts, prepared

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is nothing, then the kinds.
LABELS = 1 + len(KINDS)
SURE, ROUNDS, SAMPLE_NODES, KNOWN = 0.9, 60, 1000, 8.0

#: Fixed patterns of the base.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small_parts(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def good(kind: str, text: str) -> bool:
    """The test that a match of a kind has to pass."""
    if kind == "ip":
        return small_parts(text)
    digits = digits_of(text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start; every pattern in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            out.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        if kind == "phone" and "+" not in text:
            continue
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if good(kind, m[0])]
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


RUN = r"A-Za-z0-9@._%+()/-"
#: A token with a digit or an @; it can only begin where a run of its characters does.
TOKEN = re.compile(rf"(?<![{RUN}])[A-Za-z._%+()/-]*+[0-9@][{RUN}]*+")
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD, DOTTED, AREA, NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+){3}"), re.compile(r"[0-9]+(?:\.[0-9]+)+"), re.compile(r"\([0-9]+\)"), re.compile(r"\+?[0-9]+(?:[.-][0-9]+)*")


def tokens(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in TOKEN.finditer(text):
        word = m[0].rstrip("._%+(/-@")
        front = len(word) - len(word.lstrip("._%)/-@"))
        word = word[front:]
        if word.startswith("(") and ")" not in word:
            front, word = front + 1, word[1:]
        if word.endswith(")") and "(" not in word:
            word = word.rstrip(")")
        if word:
            out.append((m.start() + front, m.start() + front + len(word), word))
    return out


LOOKS = (
    "bias", "mail", "at", "quad", "large_quad", "dotted", "plus", "area", "number", "mixed", "letters_many", "d1", "d2", "d3", "d4", "d5-6", "d7", "d8-9", "d10-12", "d13-19", "d20", "luhn", "no_luhn", "dashes",
)
RUNS = ("alone", "first", "last", "behind_plus", "plus_over", "before_plus", "behind_area", "fours_luhn", "near_quad")
FEATURES = (*LOOKS, *RUNS)
PLACE = {f: i for i, f in enumerate(FEATURES)}


def count_name(n: int) -> str:
    for top, name in ((1, "d1"), (2, "d2"), (3, "d3"), (4, "d4"), (6, "d5-6"), (7, "d7"), (9, "d8-9"), (12, "d10-12"), (19, "d13-19")):
        if n <= top:
            return name
    return "d20"


def looks(word: str) -> set[str]:
    """What a token looks like by itself."""
    digits, out = digits_of(word), {"bias"}
    letters = sum(c.isalpha() for c in word)
    if "@" in word:
        out |= {"at", "mail"} if MAIL.fullmatch(word) else {"at"}
        return out
    if digits:
        out.add(count_name(len(digits)))
    if QUAD.fullmatch(word):
        out.add("quad" if small_parts(word) else "large_quad")
    elif DOTTED.fullmatch(word):
        out.add("dotted")
    elif AREA.fullmatch(word):
        out.add("area")
    elif NUMBER.fullmatch(word):
        out.add("number")
    if word.startswith("+"):
        out.add("plus")
    if "-" in word:
        out.add("dashes")
    if letters:
        out.add("letters_many" if letters > 2 else "mixed")
    elif 13 <= len(digits) <= 19:
        out.add("luhn" if luhn(digits) else "no_luhn")
    return out


def key_of(word: str) -> str:
    """Mentions with equal keys are linked; empty: too short to tell."""
    if "@" in word:
        return word.lower()
    digits = digits_of(word)
    if QUAD.fullmatch(word):
        return word
    if len(digits) >= 7 and not any(c.isalpha() for c in word):
        return "#" + digits[-7:]
    return word.lower() if len(word) >= 5 else ""


def described(text: str) -> dict | None:
    """Nodes of a text: places, features, whether each follows the one before with at most two spaces between, links (to, exact)."""
    found = tokens(text)
    if not found:
        return None
    joins = [False] + [0 <= b - a <= 2 and not text[a:b].strip(" ") for (_, a, _), (b, _, _) in zip(found, found[1:], strict=False)]
    seen = [looks(w) for _, _, w in found]
    spread = [0] * len(found)
    plus = area = False
    for i, (_, _, word) in enumerate(found):
        mine, n = seen[i], len(digits_of(word))
        if not joins[i]:
            plus = area = False
            total = 0
        last = i + 1 == len(found) or not joins[i + 1]
        mine |= {"alone"} if last and not joins[i] else {"first"} if not joins[i] else {"last"} if last else set()
        quad = "quad" in mine or "large_quad" in mine
        if "plus" in mine:
            plus, total = True, n
        elif plus:
            total += n
            mine.add("behind_plus" if total <= 15 and not quad else "plus_over")
        if area and "d7" in mine:
            mine.add("behind_area")
        area = "area" in mine
        if not last and "area" not in mine and found[i + 1][2].startswith("+"):
            mine.add("before_plus")
        if not last and QUAD.fullmatch(found[i + 1][2]):
            mine.add("near_quad")
        fours = found[i : i + 4]
        if len(fours) == 4 and all(joins[i + 1 : i + 4]) and all(len(w) == 4 and w.isdigit() for _, _, w in fours) and luhn("".join(w for _, _, w in fours)):
            spread[i : i + 4] = [1] * 4
    for mine, four in zip(seen, spread, strict=True):
        mine |= {"fours_luhn"} if four else set()
    before: dict[str, int] = {}
    links = []
    for i, (_, _, word) in enumerate(found):
        if key := key_of(word):
            if key in before:
                links.append([before[key], i, int(found[before[key]][2].lower() == word.lower())])
            before[key] = i
    return {"at": [[a, b] for a, b, _ in found], "features": [sorted(PLACE[f] for f in s) for s in seen], "joins": [int(j) for j in joins], "links": links}


def gold(nodes: dict, spans) -> list[int]:
    """Labels that base spans give; where kinds overlap, the first one."""
    labels, at = [0] * len(nodes["at"]), 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        while at < len(labels) and nodes["at"][at][1] <= a:
            at += 1
        i = at
        while i < len(labels) and nodes["at"][i][0] < b:
            labels[i] = labels[i] or 1 + KINDS.index(kind)
            i += 1
    return labels


def example(*stretches: tuple[str, int]) -> tuple[dict, list[int]]:
    """Nodes and labels of a made text; each stretch of text has one label."""
    text, marks = "", []
    for piece, label in stretches:
        marks.append((len(text), len(text) + len(piece), label))
        text += piece
    nodes = described(text)
    return nodes, [next((label for a, b, label in marks if a <= x < b), 0) for x, _ in nodes["at"]]


def examples(documents: list[dict], seed: int = 11) -> list[tuple[dict, list[int]]]:
    """Made examples of other forms and neighbours of the spans of the given documents."""
    rng = np.random.default_rng(seed)

    def number(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    out = []
    for d in documents:
        i = 0
        while i < len(d["gold"]):
            j = i + 1
            while j < len(d["gold"]) and d["gold"][j] == d["gold"][i] and d["joins"][j] and "plus" not in names(d, j):
                j += 1
            label, whole = d["gold"][i], " ".join(d["words"][i:j])
            i = j
            if not label:
                continue
            kind, digits = KINDS[label - 1], digits_of(whole)
            if kind == "phone" and 9 <= len(digits) <= 15 and whole.startswith("+"):
                bare = whole.split(" ", 1)[-1].lstrip("+")
                forms = (bare, digits[-10:], digits[-7:-4] + "-" + digits[-4:], digits)
                form = forms[int(rng.integers(len(forms)))]
                quad = ".".join(str(x) for x in rng.integers(1, 256, 4))
                out += [example((whole, 4), (" so it ", 0), (form, 4)), example((whole, 4), (" so it ", 0), (form, 4), (" or ", 0), (forms[0], 4)), example((form, 0)), example((whole, 4), (" ", 0), (quad, 2)), example((form, 0), (" so ", 0), (form, 0))]
            elif kind == "card":
                groups = " ".join(digits[k : k + 4] for k in range(0, len(digits), 4))
                out += [example((digits, 3), (" ", 0), (number(int(rng.integers(1, 5))), 0)), example((number(16), 0)), example((digits, 3), (" so ", 0), (digits, 3))]
                out += [example((groups, 3), (" ", 0), (number(2), 0))] if len(digits) == 16 else []
            elif kind in ("email", "ip"):
                out.append(example((whole, label), (" so ", 0), (whole, label)))
            year = 1900 + int(rng.integers(200))
            odd = (f"{year}-0{1 + year % 9}-{10 + year % 18}", f"{year}-{year + 1}", number(3) + " " + number(1), number(10), number(7), f"({year})", f"{number(3)} {number(3)} {number(4)}", f"+{year % 90}", number(3) + "-" + number(4))
            one, two = rng.integers(len(odd), size=2)
            out.append(example((odd[one], 0), (" ", 0), (odd[two], 0), (" so ", 0), (odd[one], 0)))
    return out


@dataclass(frozen=True)
class Field:
    """Weights: node (features, labels), chain (before, after), border at either end of a run, skip (similar or exact, labels, labels)."""

    node: np.ndarray
    chain: np.ndarray
    border: np.ndarray
    skip: np.ndarray

    @staticmethod
    def blank() -> Field:
        return Field(np.zeros((len(FEATURES), LABELS)), np.zeros((LABELS, LABELS)), np.zeros((2, LABELS)), np.zeros((2, LABELS, LABELS)))


class Graph:
    """The nodes of several documents as arrays."""

    def __init__(self, documents: list[dict]):
        sizes = np.array([len(d["at"]) for d in documents], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.n = int(sizes.sum())
        self.x = np.zeros((self.n, len(FEATURES)))
        counts = [len(f) for d in documents for f in d["features"]]
        self.x[np.repeat(np.arange(self.n), counts), [i for d in documents for f in d["features"] for i in f]] = 1
        joins = np.array([j for d in documents for j in d["joins"]], dtype=bool)
        after = np.flatnonzero(joins)
        self.chain = np.stack([after - 1, after], axis=1)
        self.starts = ~joins
        self.ends = ~np.concatenate([joins[1:], [False]])
        links = [(a + f, b + f, e) for d, f in zip(documents, first, strict=True) for a, b, e in d["links"]]
        self.skip = np.array(links, dtype=np.int64).reshape(-1, 3)

    def local(self, field: Field, x: np.ndarray | None = None) -> np.ndarray:
        """Log potentials of the nodes."""
        return (self.x if x is None else x) @ field.node + self.starts[:, None] * field.border[0] + self.ends[:, None] * field.border[1]

    def marginals(self, field: Field, known: np.ndarray | None = None) -> np.ndarray:
        """Marginals by loopy belief propagation; messages of all edges are renewed together until they settle. known: labels that the base gives (0: none)."""
        local = self.local(field)
        if known is not None:
            at = np.flatnonzero(known)
            local[at, known[at]] += KNOWN
        ends = np.concatenate([self.chain, self.skip[:, :2]])
        tables = np.concatenate([np.broadcast_to(field.chain, (len(self.chain), LABELS, LABELS)), field.skip[self.skip[:, 2]]])
        sent = np.concatenate([ends[:, 0], ends[:, 1]])
        got = np.concatenate([ends[:, 1], ends[:, 0]])
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        other = np.concatenate([np.arange(len(ends)) + len(ends), np.arange(len(ends))])
        message = np.zeros((len(sent), LABELS))
        for _ in range(ROUNDS if len(sent) else 0):
            belief = local.copy()
            np.add.at(belief, got, message)
            new = log_sum((belief[sent] - message[other])[:, :, None] + tables, 1)
            new = 0.5 * (new - log_sum(new, 1)[:, None]) + 0.5 * message
            moved = np.abs(new - message).max()
            message = new
            if moved < 1e-4:
                break
        np.add.at(local, got, message)
        return np.exp(local - log_sum(local, 1)[:, None])


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fitted(documents: list[dict], labels: list[int], *, steps: int = 400, ridge: float = 2.0, seed: int = 3) -> Field:
    """Weights of the greatest penalised pseudo-likelihood, by Adam; what runs tell is withheld from half of the nodes in each step."""
    graph, y = Graph(documents), np.array(labels, dtype=np.int64)
    if not graph.n or not y.any():
        return Field.blank()
    rng = np.random.default_rng(seed)
    truth = np.eye(LABELS)[y]
    weights = [*vars(Field.blank()).values()]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    a, b = graph.chain.T
    p, q, e = graph.skip.T
    for step in range(1, steps + 1):
        field = Field(*weights)
        x = graph.x.copy()
        x[:, len(LOOKS) :] *= rng.random((graph.n, 1)) < 0.5
        logits = graph.local(field, x)
        np.add.at(logits, b, field.chain[y[a]])
        np.add.at(logits, a, field.chain[:, y[b]].T)
        np.add.at(logits, q, field.skip[e, y[p]])
        np.add.at(logits, p, field.skip[e, :, y[q]])
        rest = truth - np.exp(logits - log_sum(logits, 1)[:, None])
        chain, skip = np.zeros_like(field.chain), np.zeros_like(field.skip)
        np.add.at(chain, y[a], rest[b])
        np.add.at(chain.T, y[b], rest[a])
        np.add.at(skip, (e, y[p]), rest[q])
        np.add.at(skip, (e, y[q]), rest[p])
        skip = skip + skip.transpose(0, 2, 1)
        slopes = [x.T @ rest, chain, np.stack([graph.starts @ rest, graph.ends @ rest]), skip / 2]
        for i, (w, g) in enumerate(zip(weights, slopes, strict=True)):
            g = g - ridge * w
            m, v = moments[i]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            moments[i] = m, v
            weights[i] = w + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights[3] = (weights[3] + weights[3].transpose(0, 2, 1)) / 2
    return Field(*weights)


def added_spans(text_of, nodes: dict, marginals: np.ndarray, base) -> list[tuple[str, int, int]]:
    """Runs of one surely labelled kind that pass its test and meet no base span."""
    label = marginals.argmax(axis=1)
    label[marginals.max(axis=1) < SURE] = 0
    out, i = [], 0
    taken: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    ends = [b for _, b in taken]
    mentions = {x for a, b, _ in nodes["links"] for x in (a, b)}
    while i < len(label):
        j = i + 1
        while j < len(label) and label[j] == label[i] and nodes["joins"][j] and label[i] in (3, 4) and "plus" not in names(nodes, j):
            j += 1
        if label[i]:
            kind, a, b = KINDS[label[i] - 1], nodes["at"][i][0], nodes["at"][j - 1][1]
            word = text_of(i, j)
            fits = bool(MAIL.fullmatch(word)) if kind == "email" else bool(QUAD.fullmatch(word)) and good(kind, word) if kind == "ip" else good(kind, word) if kind == "card" else phone_like(word, not mentions.isdisjoint(range(i, j)))
            after = bisect_right(ends, a)
            if fits and (after == len(taken) or taken[after][0] >= b):
                out.append((kind, a, b))
        i = j
    return out


def phone_like(word: str, mentioned: bool) -> bool:
    """Without a plus only a number that the document mentions again can be a phone."""
    least = 9 if word.startswith("+") else 7 if mentioned else 16
    return least <= len(digits_of(word)) <= 15 and not any(c.isalpha() for c in word)


def names(nodes: dict, i: int) -> set[str]:
    return {FEATURES[f] for f in nodes["features"][i]}


def scanned(docs: DataFrame) -> DataFrame:
    """All columns but the text, with the base spans and the nodes (null: none) of every text."""

    def compute(texts: list[bytes]):
        base, nodes = [], []
        for t in texts:
            text = t.decode("utf-8", "replace")
            spans = base_spans(text)
            found = described(text)
            if found:
                found["words"] = [text[a:b] for a, b in found["at"]]
                found["gold"] = gold(found, spans)
            base.append(joined(spans))
            nodes.append(json.dumps(found).encode() if found else None)
        return [pa.array(base), pa.array(nodes, type=pa.binary())]

    return map_texts(docs, "base_spans string, nodes binary", compute).drop("text")


def window(nodes: bytes) -> str:
    """At most SAMPLE_NODES nodes in a row of a document, without places; where they begin follows from a hash of the nodes."""
    d = json.loads(nodes)
    n = len(d["at"])
    first = zlib.crc32(nodes) % (n - SAMPLE_NODES + 1) if n > SAMPLE_NODES else 0
    last = min(n, first + SAMPLE_NODES)
    cut = {k: d[k][first:last] for k in ("at", "features", "joins", "gold", "words")}
    cut["joins"][0] = 0
    cut["links"] = [[a - first, b - first, e] for a, b, e in d["links"] if first <= a and b < last]
    return json.dumps(cut)


def fit(table: DataFrame, *, sample_rows: int = 3000) -> Field:
    """The field's weights from a bounded sample of a written table of nodes; documents with equal nodes count once."""
    prepared(table.sparkSession)
    different = written(table.where("nodes is not null").select("nodes").distinct(), "nodes")
    every = max(1, different.count() // sample_rows)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([window(x) for x in b.column(0).to_pylist()])], names=["nodes"])

    picked = different.where(F.pmod(F.xxhash64("nodes"), F.lit(every)) == 0).mapInArrow(run, "nodes string")
    documents = [json.loads(r["nodes"]) for r in picked.orderBy(F.xxhash64("nodes"), "nodes").collect()]
    return learned(documents)


def learned(documents: list[dict]) -> Field:
    """The field fitted to documents with gold labels and the examples made from them."""
    more = examples(documents)
    return fitted([*documents, *(d for d, _ in more)], [label for d in documents for label in d["gold"]] + [label for _, y in more for label in y])


def find_personal(docs: DataFrame, *, sample_rows: int = 3000, field: Field | None = None) -> DataFrame:
    """All columns but the text, with base_spans and spans (base and added), both as kind:start:end by kind and start; field: weights fitted before."""
    table = written(scanned(docs), "personal")
    field = field or fit(table, sample_rows=sample_rows)
    columns = [c for c in table.columns if c not in ("base_spans", "nodes")]
    packed = table.select(F.struct(*(table[c] for c in columns)).alias("row"), "base_spans", "nodes")

    def run(batches):
        for part in parts(batches, 500):
            base = [[(k, int(a), int(b)) for k, a, b in (s.split(":") for s in t.split(",") if s)] for t in part.column(1).to_pylist()]
            nodes = [json.loads(x) if x else None for x in part.column(2).to_pylist()]
            some = [d for d in nodes if d]
            all_spans, at = [], 0
            marginals = Graph(some).marginals(field, np.array([y for d in some for y in d["gold"]])) if some else None
            for d, spans in zip(nodes, base, strict=True):
                if d:
                    n = len(d["at"])
                    spans = spans + added_spans(lambda i, j, d=d: " ".join(d["words"][i:j]), d, marginals[at : at + n], spans)
                    at += n
                all_spans.append(joined(spans))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(all_spans)], names=["row", "base_spans", "spans"])

    out = packed.mapInArrow(run, StructType([*packed.schema.fields[:2], StructField("spans", StringType())]))
    kept = [c for c in columns if c.lower() not in ("base_spans", "spans")]
    return out.select(*(F.col("row").getField(c).alias(c) for c in kept), "base_spans", "spans")
