"""Personal data by weak supervision.

Four labelers - strictness of the form, gazetteers, context cues, checksums - vote yes, no or abstain on every candidate
span; each kind has votes from two of them at least. Expectation-maximisation over the table of vote patterns (counted over
all documents; its size is bounded by the number of patterns, not by the data) estimates each labeler's reliability without
labels. Its posteriors train a logistic span classifier that sees what the labelers don't: the characters around the span,
its length, the share of digits and its place in the line, each for its kind, and of the votes only the checksum. That
classifier decides which candidates are reported. The base kinds email, ip, card and phone are exact patterns and always
stay; they are candidates too, since they teach what personal data looks like. Among the added kinds are phone and card
numbers that the base patterns lose because they run on into other digits.

Texts are scanned once; what later steps read is a table of spans without texts.

Defined results: null text is empty; an empty text has no spans; repeated rows each give a row; a null doc_id stays null;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actispark.llm.common import documents, give_back, materialise

#: The base kinds in their order, and the kinds that the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("email_words", "phone_local", "phone_part", "card_part", "ssn", "iban", "name")
CODE = {k: i for i, k in enumerate(BASE + ADDED)}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DOTS = "dot|punkt|point|punto"
_DOT = re.compile("(?i)" + _DOTS)  # what e-mails in words can't do without, by the case rules of their pattern
_WEAK = {
    "email_words": re.compile(r"(?i)(?<![\w.%+-])[a-z0-9._%+-]{2,64} ?[(\[{]? ?(?:at|arroba) ?[)\]}]? [a-z0-9-]{2,63} ?[(\[{]? ?(?:" + _DOTS + r") ?[)\]}]? [a-z]{2,10}(?![\w])"),
    "phone_local": re.compile(r"(?<![\w.+(-])(?<!\+[0-9][ .-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])"),
    "phone_part": re.compile(r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3}[ .-]?[0-9]{4}(?![0-9])"),
    "card_part": re.compile(r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)"),
    "name": re.compile(r"(?<!\w)(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Señor|Señora)\.? )?[A-ZÀ-Þ][a-zß-ÿ]+ [A-ZÀ-Þ][a-zß-ÿ]+(?!\w)"),
}
_TITLES = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Señor", "Mrs")
#: Small gazetteers - given names, top-level domains, calling codes, issuers' first digits, networks that are
#: nobody's, countries with an IBAN - and context cues in the four languages of the documents.
GIVEN = frozenset("James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Hans Anna Peter Ursula Wolfgang Monika Jean Marie Pierre Nathalie Michel Isabelle Antonio Carmen Manuel Josefa Francisco Dolores".split())
DOMAINS = frozenset("com org net edu gov de fr es uk io info".split())
CALLING = ("1", "44", "49", "33", "34", "41", "43", "39", "31", "32")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35")
NO_HOSTS = ("0.", "127.", "255.", "169.254.")
IBANS = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
_MAIL = ("mail", "contact", "write", "kontakt", "schreib", "contacter", "écri", "correo", "escrib")
_CALL = ("call", "tel", "phone", "mobile", "fax", "anruf", "handy", "appel", "portable", "llam", "móvil")
_PAY = ("card", "visa", "pay", "credit", "karte", "kredit", "carte", "paie", "tarjeta", "pago")
CUES = {
    "email": _MAIL, "ip": ("ip", "host", "server", "address", "adresse", "serveur", "servidor"), "card": _PAY, "phone": _CALL, "email_words": _MAIL, "phone_local": _CALL, "phone_part": _CALL, "card_part": _PAY,
    "ssn": ("ssn", "social", "security", "sozial", "sécurité", "seguridad"), "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"), "name": ("name", "contact", "signed", "sincerely", "gruß", "nom", "nombre", "firma"),
}
AGAINST = ("version", "isbn", "order", "invoice", "page", "section", "chapter", "seite", "rechnung", "facture", "página", "factura")


def luhn(digits: str) -> bool:
    n = [int(c) for c in reversed(digits)]
    return (sum(n[0::2]) + sum(x * 2 - 9 * (x > 4) for x in n[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place, start, end), by kind, then start; leftmost and non-overlapping for each kind."""
    out, past = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):  # looked at backwards from its @, so each character at most once
            start = m.start()
            while start > past and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, past := m.end()))
    if not _DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) < 4 and int(q or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def _checksum(kind: str, s: str) -> int:
    if kind == "iban":
        x = s.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1 else -1
    if kind == "ssn":
        return -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 1
    if kind in ("card", "card_part"):
        return 1 if luhn(_plain(s)) else -1
    return 0


def _plain(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _lexicon(kind: str, s: str) -> int:
    if kind == "name":
        return 1 if GIVEN & set(s.split()) else -1
    if kind in ("email", "email_words"):
        return 1 if re.split(r"[. ]", s.lower())[-1] in DOMAINS else -1
    if kind in ("card", "card_part"):
        return 1 if _plain(s).startswith(ISSUERS) else -1
    if kind in ("phone", "phone_part"):
        return 1 if _plain(s).startswith(CALLING) else -1
    if kind == "ip":
        return -1 if s.startswith(NO_HOSTS) else 1
    if kind == "iban":
        return 1 if s[:2] in IBANS else -1
    return 0


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """Each labeler's vote on the span (1, 0 for abstain, -1)."""
    s, before = text[start:end], text[max(0, start - 48) : start].lower()
    if kind == "email":
        form = 1 if ".." not in s and s[0] not in ".-" else -1
    elif kind == "email_words":
        form = 1 if re.search(r"[(\[{]", s) else -1
    elif kind == "ip":
        form = -1 if any(len(p) > 3 or len(p) > 1 and p[0] == "0" for p in s.split(".")) else 1
    elif kind in ("phone", "phone_part"):
        form = 1 if "(" in s or "-" in s or " " in s else 0
    elif kind == "phone_local":
        form = 1 if s.count("-") == 2 or s[0] == "(" else 0
    elif kind in ("card", "card_part"):
        form = 1 if len(s) == 16 or re.fullmatch(r"[0-9]{4}([ -])[0-9]{4}(\1[0-9]{4}){2}", s) else 0
    elif kind == "name":
        form = 1 if s.startswith(_TITLES) else 0
    else:
        form = 1
    context = -1 if any(w in before for w in AGAINST) else 1 if any(w in before for w in CUES[kind]) else 0
    return form, _lexicon(kind, s), context, _checksum(kind, s)


def _around(c: str) -> int:
    """The kind of a neighbouring character: none or a line break, blank, letter, digit, other."""
    return 0 if c in ("", "\n") else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


def _shape(text: str, start: int, end: int) -> int:
    """What the classifier sees, packed: the characters before (0-4) and behind (0-4), length (0-3), share of digits (0-3)."""
    digits = sum("0" <= c <= "9" for c in text[start:end][:64])
    size = min(end - start, 64)
    return ((_around(text[start - 1 : start]) * 5 + _around(text[end : end + 1])) * 4 + min(3, (end - start) // 10)) * 4 + min(3, 4 * digits // size)


SHAPES = 5 * 5 * 4 * 4


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """All spans to vote on, base ones with them; code packs the votes (base 3) and the shape. A candidate that overlaps a
    base span is left out: base spans are merged into sorted, disjoint ones, and each candidate looks one of them up."""
    spans = [(BASE[k], a, b) for k, a, b in base]
    starts, ends = [], []
    for _, a, b in sorted(base, key=lambda x: x[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(a: int, b: int) -> bool:
        i = bisect.bisect_right(ends, a)  # the first base span that ends behind a
        return i == len(ends) or starts[i] >= b

    digits = bool(_DIGIT.search(text))
    for kind, r in _WEAK.items():
        if kind in ("phone_local", "card_part", "ssn", "iban") and not digits or kind == "phone_part" and "+" not in text or kind == "email_words" and not _DOT.search(text):
            continue
        if kind == "name" and not any(t in text for t in _TITLES) and not any(g in text for g in GIVEN):
            continue
        spans += [(kind, *m.span()) for m in r.finditer(text) if free(*m.span()) and (kind != "name" or m[0].startswith(_TITLES) or GIVEN & set(m[0].split()))]
    out = []
    for kind, a, b in spans:
        code = 0
        for v in votes(kind, text, a, b):
            code = code * 3 + v + 1
        out.append({"kind": CODE[kind], "start": a, "end": b, "code": code * SHAPES + _shape(text, a, b)})
    return out


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base_spans string, found array<struct<kind:int,start:int,end:int,code:int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "start", "end", "code")]))
    for batch in batches:
        rows: list[list] = [[] for _ in range(7)]
        for text in batch.column(1):
            t = text.as_py() or ""
            base = base_spans(t)
            joined = ",".join(f"{BASE[k]}:{a}:{b}" for k, a, b in base)
            n = [sum(k == i for k, _, _ in base) for i in range(4)]
            for at, x in zip(rows, (*n, hashlib.sha256(joined.encode()).hexdigest(), joined, candidates(t, base)), strict=True):
                at.append(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in rows[:4]), *(pa.array(x, pa.string()) for x in rows[4:6]), pa.array(rows[6], kind)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base_spans", "found"])
    give_back()


def unpack(code: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Votes and shape of a code."""
    code, shape = divmod(code, SHAPES)
    v = []
    for _ in range(4):
        code, r = divmod(code, 3)
        v.append(r - 1)
    return tuple(reversed(v)), (shape // 80, shape // 16 % 5, shape // 4 % 4, shape % 4)


def em(kinds: np.ndarray, v: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each pattern being personal data, and the labelers' tables P(vote | class, not abstaining) of shape
    (labelers, 2, 3). Patterns have counts n; each kind has its own prior; the votes are independent given the class, and
    an abstention tells nothing (the middle column is 1), since most labelers abstain on whole kinds."""
    post = 1 / (1 + np.exp(-1.5 * v.sum(1)))
    table = np.ones((v.shape[1], 2, 3))
    for _ in range(rounds):
        w = np.stack([(1 - post) * n, post * n])  # class, pattern
        for c, right in ((0, -1), (1, 1)):
            for x in (-1, 1):
                table[:, c, x + 1] = (w[c][:, None] * (v == x)).sum(0) + (2 if x == right else 1)
            table[:, c, ::2] /= table[:, c, ::2].sum(1, keepdims=True)
        prior = np.array([(w[1][kinds == k].sum() + 1) / (n[kinds == k].sum() + 2) for k in kinds])
        logit = np.log(prior / (1 - prior)) + sum(np.log(table[j, 1, v[:, j] + 1] / table[j, 0, v[:, j] + 1]) for j in range(v.shape[1]))
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, table


def span_features(kinds: np.ndarray, checksum: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Indicators of kind, checksum and each part of the shape, and of the shape's parts for each kind."""
    one = lambda a, size: (a[:, None] == np.arange(size)).astype(float)
    kind = one(kinds, len(CODE))
    parts = np.hstack([one(shape[:, i], size) for i, size in enumerate((5, 5, 4, 4))] + [one(checksum + 1, 3)[:, ::2]])
    return np.hstack([np.ones((len(kinds), 1)), kind, parts, (kind[:, :, None] * parts[:, None, :]).reshape(len(kinds), -1)])


def fit(patterns: list[tuple[int, int, int]], steps: int = 300) -> set[tuple[int, int]]:
    """The (kind, code) that the span classifier accepts, from all (kind, code, count)."""
    if not patterns:
        return set()
    kinds, codes, n = (np.array(x) for x in zip(*patterns, strict=True))
    v, shape = (np.array(x) for x in zip(*map(unpack, codes.tolist()), strict=True))
    post, _ = em(kinds, v, n)
    x = span_features(kinds, v[:, 3], shape)
    w, weight = np.zeros(x.shape[1]), np.sqrt(n) / np.sqrt(n).sum()  # the root, or the commonest pattern would be all there is
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (p - post)) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    p = 1 / (1 + np.exp(-x @ w))
    return {(int(k), int(c)) for k, c, q in zip(kinds, codes, p, strict=True) if q >= 0.5}


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    scanned = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, _SCHEMA), "pii")
    counts = scanned.select(F.explode("found").alias("f")).groupBy("f.kind", "f.code").count().collect()  # at most a row for each pattern
    accepted = sorted((k, c) for k, c in fit([tuple(r) for r in counts]) if k >= len(BASE))
    ok = F.array(*[F.lit(k * 2**20 + c) for k, c in accepted]).cast("array<int>")
    added = F.array_sort(F.transform(F.filter("found", lambda f: F.array_contains(ok, f["kind"] * 2**20 + f["code"])), lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in CODE])
    text = F.array_join(F.transform(added, lambda f: F.concat_ws(":", F.element_at(names, f["kind"] + 1), f["start"].cast("string"), f["end"].cast("string"))), ",")
    spans = F.concat_ws(",", F.when(F.col("base_spans") != "", F.col("base_spans")), F.when(text != "", text))
    return scanned.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), F.size(added).cast("long").alias("n_added"))


def op1_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))
