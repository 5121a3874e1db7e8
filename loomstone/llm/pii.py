"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Patterns propose candidate spans. Regex, gazetteer and context labelers vote on each (yes, no, abstain).
Expectation-maximisation over the counted vote patterns of the whole corpus estimates how reliable each labeler is
and how likely each kind is personal; a logistic span classifier is then trained on those posteriors. Spans of the
four base kinds always stay; candidates of the other kinds stay where the classifier says so.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.common import stored
from loomstone.session import table

# Base kinds in the order in which equal starts are listed, and their patterns.
BASE = ("email", "ip", "card", "phone")
# Each reads a run of its characters once: searches that would begin anew at every character of a run begin at its edge.
MAILBOX = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Kinds that only the classifier can admit.
KINDS = (*BASE, "hidden_email", "local_phone", "national_id", "iban", "person")
HIDDEN = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[] ?(?:at|AT) ?[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[] ?(?:dot|DOT) ?[)\]]) ?[A-Za-z0-9-]{1,63})+")
LOCAL = re.compile(r"(?<![0-9+.-])\(?0?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
PERSON = re.compile(r"\b(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.? [A-ZÀ-Þ][\w'-]+(?: [A-ZÀ-Þ][\w'-]+)?)")
FIRST, LAST = re.compile(r"\b[A-ZÀ-Þ][a-zà-ÿ]{1,20}(?= [A-ZÀ-Þ][a-zà-ÿ'-]{2})"), re.compile(r" [A-ZÀ-Þ][a-zà-ÿ'-]{2,30}")
AT = re.compile(r"[(\[] ?(?:at|AT) ?[)\]]")

# Gazetteers and cue words; names and endings are parameters of ``find_personal_data``, these are what it has without them.
MAIL_ENDS = frozenset(
    "com org net edu gov mil int info biz name io co me tv app dev ai eu ac ad ae ar at au be bg br ca ch cl cn cy cz de dk ee es fi fr gr hk hr hu id ie il in is it jp ke kr li lt lu lv mx my "
    "ng nl no nz pe ph pl pt ro rs ru se sg si sk th tr tw ua uk us uy vn za".split()
)
CALLING_CODES = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 211 212 213 216 218 220 221 225 234 254 255 256 260 263 "
    "350 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 380 381 385 386 387 389 420 421 423 852 853 855 880 886 961 962 963 964 965 966 967 968 971 972 973 974 975 976 977 992 994 995 998"
).split()
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "22", "35", "36", "30")
FIRST_NAMES = frozenset(
    "Adam Alan Albert Alex Alice Alma Amanda Amy Ana Andrea Andrew Angela Anna Anne Anton Antonio Barbara Beatriz Ben Benjamin Bernd Brian Carla Carlos Carmen Caroline Catherine Charles Charlotte Chloé "
    "Chris Christian Christine Claire Clara Claudia Cristina Daniel David Deborah Diana Diego Dieter Donald Edward Elena Elisabeth Elizabeth Emily Emma Eric Erik Eva Felix Fernando Frank Françoise Fritz "
    "Gabriel George Georg Gerhard Greta Hans Heike Heinz Helen Helga Henri Isabel Jack Jacob Jacques James Jan Jane Javier Jean Jennifer Jessica Joe Johann John Jonas Jorge José Joseph Juan Julia Julie "
    "Karen Karin Karl Kevin Klaus Laura Lena Leon Linda Lisa Louis Louise Lucas Lucía Luis Lukas Manuel Margaret Maria Marie Mario Mark Martin Mary Matthew Michael Michel Miguel Monika Nancy Natalie "
    "Nicolas Nina Olivia Oscar Pablo Patricia Patrick Paul Paula Pedro Peter Petra Philip Pierre Rachel Ralf Ramón Rebecca Richard Robert Rosa Ruth Samuel Sandra Sara Sarah Sebastian Simon Sofía Sophie "
    "Stefan Stephen Susan Sven Teresa Thomas Tim Ursula Uwe Victor Walter William Wolfgang Yvonne".split()
)
CUES = {
    "email": "mail contact write address reach send", "hidden_email": "mail contact write address reach send", "ip": "ip host address server client login", "card": "card visa pay credit karte carte tarjeta",
    "phone": "phone tel call mobile fax cell ring whatsapp", "local_phone": "phone tel call mobile fax cell ring whatsapp", "national_id": "ssn social security tax id", "iban": "iban bank account konto compte cuenta", "person": "name contact by from signed dear author",
}
CUES = {k: tuple(v.split()) for k, v in CUES.items()}
DENIALS = ("version", "isbn", "figure", "section", "build", "release", "chapter", "example", "order no", "invoice", "serial", "part no")
#: What labelers look at: the span's form, lists, words before it, words that deny it, other spans near by, words after it, marks around it.
LABELERS = ("format", "gazetteer", "cue", "denial", "company", "after", "frame")
AROUND, NEAR = 40, 200


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in MAILBOX:
            begin -= 1
        found = HOST.match(text, at) if begin < at else None
        if found:
            last = found.end()
            yield begin, 0, last
        else:
            last = max(last, begin)  # what stands before has no other mark, so it is not read again
        at = text.find("@", max(at + 1, last))


def _addresses(text: str) -> Iterator[tuple[int, int, int]]:
    """Four parts each of longer runs of dotted numbers, from the left."""
    for m in DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) <= 3 or len(p.lstrip("0")) <= 3 for p in four) and all(int(p[-4:]) <= 255 for p in four):
                yield at, 1, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base kinds: leftmost, non-overlapping per kind, failing matches dropped. The time is
    in proportion to the length of the text, whatever it holds."""
    out = list(_emails(text)) + list(_addresses(text))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out)


def _people(text: str, names: frozenset[str]) -> Iterator[tuple[int, int]]:
    """Capitalised words after a title, and a listed first name with a capitalised word."""
    for m in PERSON.finditer(text):
        yield m.span()
    for m in FIRST.finditer(text):
        if m.group() in names:
            yield m.start(), LAST.match(text, m.end()).end()


def other_spans(text: str, base: list[tuple[int, int, int]], names: frozenset[str] = FIRST_NAMES) -> list[tuple[int, int, int]]:
    """Candidates of the other kinds that no base span and no earlier candidate overlaps."""
    rules = [(HIDDEN, bool(AT.search(text))), (LOCAL, True), (NATIONAL, "-" in text), (IBAN, True)]
    found = [(m.start(), k, m.end()) for k, (rule, may) in enumerate(rules, len(BASE)) if may for m in rule.finditer(text)]
    found += [(s, KINDS.index("person"), e) for s, e in _people(text, names)]
    if not found:
        return []
    ends, starts, last = [], [], 0
    for s, _, e in base:
        starts.append(s)
        ends.append(last := max(last, e))
    out, edge = [], 0
    for s, k, e in sorted(found):
        i = bisect.bisect_left(starts, e)
        if s >= edge and not (i and ends[i - 1] > s):
            out.append((s, k, e))
            edge = e
    return out


def _format_vote(kind: str, s: str) -> int:
    d = _digits(s)
    if kind == "iban":
        bare = s.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1 else -1
    if kind == "national_id":
        return -1 if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else 1
    if kind == "local_phone":
        return -1 if len(set(d)) < 3 else 1
    return 1 if kind != "person" else 0


def _gazetteer_vote(kind: str, s: str, names: frozenset[str], ends: frozenset[str]) -> int:
    d = _digits(s)
    if kind in ("email", "hidden_email"):
        return 1 if re.split(r"[^A-Za-z]+", s.strip(")] "))[-1].lower() in ends else -1
    if kind == "ip":
        a = [int(p[-4:]) for p in s.split(".")]
        return -1 if a[0] in (0, 10, 127) or a[0] >= 224 or a[:2] == [192, 168] else 1
    if kind == "card":
        return 1 if d.startswith(ISSUERS) else -1
    if kind == "phone":
        return 1 if any(d.startswith(c) for c in CALLING_CODES) else -1
    if kind == "person":
        return 1 if set(s.replace(".", " ").split()) & names else 0
    return 0


def votes(text: str, start: int, kind: int, end: int, centres: list[int], mine: int, names: frozenset[str] = FIRST_NAMES, ends: frozenset[str] = MAIL_ENDS) -> tuple[int, ...]:
    """One vote per labeler: 1 personal, -1 not, 0 no opinion. ``centres``: sorted starts of all spans of the text."""
    name, s = KINDS[kind], text[start:end]
    around, behind = text[max(0, start - AROUND) : start].lower(), text[end : end + AROUND].lower()
    near = bisect.bisect_left(centres, start - NEAR), bisect.bisect_right(centres, start + NEAR)
    before, after = around.rstrip()[-1:], behind.lstrip()[:1]
    frame = 1 if before in (":", "<", "=") or after == ">" else -1 if before in ("/", "#", "_", "$") or after in ("/", "_", "=") else 0
    return (
        _format_vote(name, s), _gazetteer_vote(name, s, names, ends), 1 if any(c in around for c in CUES[name]) else 0,
        -1 if any(c in around for c in DENIALS) else 0, 1 if near[1] - near[0] > mine else 0, 1 if any(c in behind for c in CUES[name]) else 0, frame,
    )


def encode(kind: int, cast: tuple[int, ...], length: int) -> int:
    """A candidate's features as one number: kind, votes, length class. There are ``9 * 3**7 * 4`` of them, 78,732."""
    code = kind
    for v in cast:
        code = code * 3 + v + 1
    return code * 4 + min(3, length // 12)


def decode(code: int) -> tuple[int, list[int], int]:
    length, code = code % 4, code // 4
    cast = []
    for _ in LABELERS:
        cast.append(code % 3 - 1)
        code //= 3
    return code, cast[::-1], length


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over vote patterns: posteriors per code, ``[labeler, truth, vote]`` probabilities, prior per kind.

    Votes are taken as independent given the truth, which is hidden; every count is smoothed. It starts from the
    share of yes among the votes that are cast.
    """
    parts = [decode(int(c)) for c in codes]
    kind = np.array([p[0] for p in parts])
    cast = np.array([p[1] for p in parts]).reshape(-1, len(LABELERS)) + 1
    weight = counts.astype(float)
    yes, no = (cast == 2).sum(axis=1), (cast == 0).sum(axis=1)
    post = (yes + 0.5) / (yes + no + 1.0)
    table_ = np.zeros((len(LABELERS), 2, 3))
    prior = np.full(len(KINDS), 0.5)
    for _ in range(rounds):
        for truth, p in ((0, 1 - post), (1, post)):
            for k in range(len(LABELERS)):
                c = np.bincount(cast[:, k], weight * p, 3) + 1.0
                table_[k, truth] = c / c.sum()
        prior = (np.bincount(kind, weight * post, len(KINDS)) + 1) / (np.bincount(kind, weight, len(KINDS)) + 2)
        # A labeler is never taken to vote against its own meaning.
        table_[:, 1, 2] = np.maximum(table_[:, 1, 2], table_[:, 0, 2])
        table_[:, 0, 0] = np.maximum(table_[:, 0, 0], table_[:, 1, 0])
        table_ /= table_.sum(axis=2, keepdims=True)
        log = [np.log(table_[np.arange(len(LABELERS)), t, cast]).sum(axis=1) for t in (0, 1)]
        odds = log[1] - log[0] + np.log(prior[kind] / (1 - prior[kind]))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, table_, prior


def _features(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), len(KINDS) + 3 * len(LABELERS) + 4))
    for row, code in enumerate(codes):
        kind, cast, length = decode(int(code))
        out[row, kind] = 1
        for k, v in enumerate(cast):
            out[row, len(KINDS) + 3 * k + v + 1] = 1
        out[row, len(KINDS) + 3 * len(LABELERS) + length] = 1
    return out


def train_classifier(codes: np.ndarray, counts: np.ndarray, posts: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method over distinct feature rows; returns their scores."""
    x, n = _features(codes), counts.astype(float)
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (n * (posts - p)) - ridge * beta
        hessian = (x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))


def _scan(text: str | None, names: frozenset[str], ends: frozenset[str]) -> tuple[int, int, int, int, str, str]:
    text = text or ""
    base = base_spans(text)
    found = sorted(base + other_spans(text, base, names))
    if not found:
        return 0, 0, 0, 0, "", ""
    centres = [s for s, _, _ in found]
    own = Counter(centres)
    listed = [(s, k, e, encode(k, votes(text, s, k, e, centres, own[s], names, ends), e - s)) for s, k, e in found]
    kinds = Counter(k for _, k, _ in base)
    return (*(kinds[k] for k in range(4)), ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base), ",".join(f"{KINDS[k]}:{s}:{e}:{c}" for s, k, e, c in listed))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, names: frozenset[str] = FIRST_NAMES, ends: frozenset[str] = MAIL_ENDS) -> DataFrame:
    """One row per input row: ``id, n_email, n_ip, n_card, n_phone, base, spans, scores``, spans as ``kind:start:end``
    text, scores as the classifier's probability for each of them (four decimals), in the same order.

    Offsets are code points, ends exclusive. ``names`` and ``ends`` are the gazetteers of first names and mail endings,
    which travel with the tasks. Defined cases: a null text is empty, a very long one takes time in proportion, repeated
    rows and null ids are scanned each for itself, an empty table gives an empty result, other columns are not looked
    at. Only counts per feature code reach the driver, of which there is a fixed number.
    """

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base string, listed string")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([_scan(t, names, ends) for t in texts], columns=["n_email", "n_ip", "n_card", "n_phone", "base", "listed"])

    found = docs.select(F.col(id_col).alias("id"), scanned(F.col(text_col)).alias("x")).select("id", "x.*")
    found = stored(found, "personal")
    codes = found.where("listed <> ''").select(F.explode(F.split("listed", ",")).alias("c")).select(F.substring_index("c", ":", -1).cast("int").alias("code"))
    counted = sorted((r["code"], r["n"]) for r in codes.groupBy("code").agg(F.count("*").alias("n")).collect())
    score: dict[int, float] = {}
    if counted:
        code, n = (np.array(v) for v in zip(*counted, strict=True))
        score = {int(c): float(p) for c, p in zip(code, train_classifier(code, n, estimate(code, n)[0]), strict=True)}

    @F.pandas_udf("spans string, scores string")
    def judged(listed: pd.Series) -> pd.DataFrame:
        out = []
        for text in listed:
            parts = [(c, score[int(c.rpartition(":")[2])]) for c in text.split(",") if c]
            stay = [(c.rpartition(":")[0], p) for c, p in parts if p >= least or c.split(":", 1)[0] in BASE]
            out.append((",".join(c for c, _ in stay), ",".join(f"{p:.4f}" for _, p in stay)))
        return pd.DataFrame(out, columns=["spans", "scores"])

    empty = F.struct(F.lit("").alias("spans"), F.lit("").alias("scores"))
    return found.select("id", "n_email", "n_ip", "n_card", "n_phone", "base", F.when(F.col("listed") == "", empty).otherwise(judged("listed")).alias("y")).select("id", "n_email", "n_ip", "n_card", "n_phone", "base", "y.spans", "y.scores")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "scores")


QUERIES = {"op6_personal_data": op6_personal_data}
ORACLES: dict[str, str] = {}
