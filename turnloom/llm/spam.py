"""Keyword-stuffed and link-list pages: robust distance of line features from those of ordinary text.

Every line of a document gets five features: density (share of links, list
separators, price and article marks), entropy (how often its content words come
again nearby), repetition (the same for its word pairs), function words, sentence
ends. Short lines are drawn towards neutral values, as they tell little.

Per language, location and scatter of all lines are estimated robustly: medians
and median absolute deviations first, then a few concentration steps, each the
mean and covariance of the lines within the cut of the last estimate. A line is
spam if its Mahalanobis distance is beyond the cut *and* it lies in a
spam-directed direction: of the squared distance, which the scatter matrix
divides among the features, most belongs to features that deviate the way spam
moves them. A document is spam if such lines hold more than half of its
characters.

The language is told from the text, since columns of languages are often wrong:
by its script, and where several languages share one by their function words. A
text without any of these (as spam often is) takes no part in the estimates and
is held against the commonest language of its script; so is a language with too
few lines to estimate from.

Features are computed in one scan and written in compact rows, one per document;
the estimates are sums over all lines, combined within each task first, of which
the driver sees a table of fixed size per language.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.batches import parts
from turnloom.session import cut

#: Common function words of languages, and the script that each is written in.
WORDS = {
    "en": (
        "latin",
        "the a an and or but if then than so because while when where what which who how that this these those there"
        " it its he she they we you i me my your his her their our us them is are was were be been being am do does did"
        " have has had not no nor can could will would shall should may might must to of in on at by for from with"
        " without into onto over under after before between about as up down out off again only just also too very more"
        " most less some any each every all both either neither one two",
    ),
    "de": ("latin", "der die das den dem des ein eine einer eines einem einen und oder aber nicht ist sind war waren wird werden mit von zu im am auf für aus bei nach wie dass sich auch noch nur wenn ich du er sie wir ihr"),
    "fr": ("latin", "le la les un une des du de et ou mais ne pas est sont était dans sur pour par avec sans au aux ce cette ces que qui il elle nous vous ils elles se son sa ses leur plus comme où je tu"),
    "es": ("latin", "el la los las un una unos unas y o pero no es son era en de del al con sin por para que se su sus lo como más este esta estos ya muy cuando donde yo tú él ella nosotros"),
    "pt": ("latin", "o a os as um uma uns umas e ou mas não é são era em de do da dos das no na nos nas com sem por para que se seu sua como mais este esta isso já muito quando onde eu ele ela nós"),
    "it": ("latin", "il lo la i gli le un uno una e o ma non è sono era in di del della dei delle al alla con senza per che si suo sua come più questo questa già molto quando dove io tu lui lei noi"),
    "nl": ("latin", "de het een en of maar niet is zijn was waren in op van voor met door uit bij naar als dat die dit deze er ook nog maar wel om te ik jij hij zij wij"),
    "ru": ("cyrillic", "и в не на я что он с как это а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему"),
    "zh": ("han", " ".join("的了是在和就也不没把被从到对与或而但都还又再很更最这那哪什么怎吗呢吧啊呀嗯么个得地着过上下里外中前后以及为因所如果可要会能该请谁给让说有我你他她它们之")),
}
#: Where scripts that one language alone is told by begin and end.
SCRIPTS = {"han": (0x3400, 0x9FFF), "kana": (0x3040, 0x30FF), "hangul": (0xAC00, 0xD7AF), "cyrillic": (0x0400, 0x052F), "arabic": (0x0600, 0x06FF), "greek": (0x0370, 0x03FF), "hebrew": (0x0590, 0x05FF), "devanagari": (0x0900, 0x097F), "thai": (0x0E00, 0x0E7F)}
LANGUAGES = tuple(WORDS)
SCRIPT_NAMES = (*SCRIPTS, "latin")

LINK = re.compile(
    r"<a\s[^>]*>[^<]*</a>|\[[^\]\n]*\]\([^)\s]*\)|https?://[!-~]+"
    r"|(?:www\.)?[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?:/[!-~]*)?",
    re.I,
)
#: What every link has: a test that is far cheaper than looking for one.
LINKED = re.compile(r"[a-z0-9-]\.[a-z]{2}|\]\(|<a\s|://", re.I)
#: Lines are read joined by a mark that is no part of a word, a blank or a sign.
MARK = "\x00"
WORD = re.compile(rf"{MARK}|[㐀-鿿]|[^\W\d_㐀-鿿]+|\d+")
ARTICLE = re.compile(r"\b[A-Z]{2,5}-\d{2,}\b")
#: Signs between the members of a list, of sums of money, and at the ends of sentences.
SEPARATORS, MONEY, ENDS = ",;，、;/|·#*•", "$€£¥", ".!?。！？…"

FEATURES = ("density", "entropy", "repetition", "function_words", "ends")
#: Which way spam moves each feature.
TOWARDS = (1, 1, 1, -1, -1)
#: What a link (as a share of the line) and a price mark (a token) weigh in the density, a separator (a token) being 1.
LINK_WEIGHT, PRICE_WEIGHT = 0.5, 1.5
#: Squared distance beyond which one line in a hundred thousand lies: the 0.99999 quantile of chi-squared with 5 degrees.
CUT = 30.86
#: Least share of the squared distance that must be spam-directed.
DIRECTED = 0.6
#: Least standard deviation of a feature: against a scatter that can't be inverted.
RIDGE = 0.01
#: Width and number of the bins in which features are counted for their medians.
BIN, BINS = 1 / 256, 4_096
#: Lines that a language needs for a model of its own.
LEAST_LINES = 500
#: Documents measured together.
DOCUMENTS = 500
#: Tokens over which recurrence is counted, and to which shorter texts are scaled (three-fold at most, from 30 tokens on).
STRETCH = 200
#: Tokens a line needs to speak for itself; neutral shares of function words and sentence ends by script.
WEIGHT = 6
NEUTRAL = {"han": (0.2, 0.06), "other": (0.3, 0.08)}

_FUNCTION: dict[str, int] = {}  # word -> bit per language
for _i, _name in enumerate(LANGUAGES):
    for _word in WORDS[_name][1].split():
        _FUNCTION[_word] = _FUNCTION.get(_word, 0) | 1 << _i


#: Kinds of characters, as bits of a table over all of them.
IN_WORD, BLANK, DIGIT, LIST_SIGN, MONEY_SIGN, END_SIGN = (1 << i for i in range(6))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    letters = [chr(i) for i in range(0x110000)]
    table = np.fromiter(map(str.isalnum, letters), np.uint8, len(letters)) * IN_WORD
    table |= np.fromiter(map(str.isspace, letters), np.uint8, len(letters)) * BLANK
    table[ord("_")] = IN_WORD
    for bit, signs in ((DIGIT, "0123456789"), (LIST_SIGN, SEPARATORS), (MONEY_SIGN, MONEY), (END_SIGN, ENDS)):
        for c in signs:
            table[ord(c)] |= bit
    return table


def _signs(joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of list separators, of prices and article numbers, and of sentence ends in a text.

    A separator is a run of list signs with a word right before and after it, but
    for a blank on either side, or a ``#`` that begins a word.
    """
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.r_[np.zeros(2, np.uint8), _kinds()[points], np.zeros(2, np.uint8)]  # two more on either side
    word, blank, sign = kinds & IN_WORD > 0, kinds & BLANK > 0, kinds & LIST_SIGN > 0
    first, last = np.flatnonzero(sign[1:-1] & ~sign[:-2]) + 1, np.flatnonzero(sign[1:-1] & ~sign[2:]) + 1
    before = word[first - 1] | (blank[first - 1] & word[first - 2])
    after = word[last + 1] | (blank[last + 1] & word[np.minimum(last + 2, len(word) - 1)])
    hashes = word[last + 1] & (points[np.clip(last - 2, 0, len(points) - 1)] == ord("#")) if len(points) else np.zeros(0, bool)
    separators = first[(before & after) | hashes] - 2
    digit = kinds & DIGIT > 0
    money = np.flatnonzero(kinds & MONEY_SIGN)
    prices = money[digit[money + 1] | (blank[money + 1] & digit[np.minimum(money + 2, len(word) - 1)])] - 2
    dashes = np.flatnonzero(points == ord("-"))
    dashes = dashes[digit[dashes + 3] & word[dashes + 1]]
    numbers = [d for d in dashes.tolist() if ARTICLE.search(joined, max(0, d - 6), min(len(joined), d + 40))]
    return separators, np.sort(np.r_[prices, np.array(numbers, np.int64)]), np.flatnonzero(kinds & END_SIGN) - 2


@dataclass
class Measured:
    """Lines of a batch of documents, one after another: ``first[d]:first[d + 1]`` are those of document d.

    ``langs`` are languages, or ``?`` and a script where no language is told. A
    line without a word or link tells nothing: its features are NaN.
    """

    langs: list[str]
    first: np.ndarray
    chars: np.ndarray
    features: np.ndarray


def _languages(doc: np.ndarray, raw: np.ndarray, script: np.ndarray, bits: np.ndarray, n: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language of each document by script and function words, its bit (0 for none), and whether its script is Han."""
    letters = script[raw]
    by_script = np.stack([np.bincount(doc[letters == k], minlength=n) for k in range(len(SCRIPT_NAMES))], 1)
    most = by_script.argmax(1)
    words = np.stack([np.bincount(doc, (bits[raw] >> i) & 1, n) for i in range(len(LANGUAGES))], 1)
    own = np.array([[WORDS[name][0] == s for name in LANGUAGES] for s in SCRIPT_NAMES])[most]
    words = np.where(own, words, 0)
    best = words.argmax(1)
    told = words[np.arange(n), best] > 0
    langs = [LANGUAGES[b] if t else f"?{SCRIPT_NAMES[m]}" for b, t, m in zip(best, told, most)]
    return langs, np.where(told, 1 << best, 0), most == SCRIPT_NAMES.index("han")


def measure(texts: list[str | None]) -> Measured:
    """Features of every line, that isn't blank, of a batch of texts, by array operations over all of its tokens."""
    bare: list[str] = []
    chars, linked, first = [], [], [0]
    for text in texts:
        if text:
            text = (text if text.isascii() else unicodedata.normalize("NFKC", text)).replace(MARK, " ")
            some = LINKED.search(text)
            for line in text.split("\n"):
                if not line or line.isspace():
                    continue
                share = 0.0
                chars.append(len(line))
                if some and LINKED.search(line):
                    rest = LINK.sub(" ", line)
                    share = max(0.0, 1 - (len(rest) - rest.count(" ")) / max(1, len(line) - line.count(" ")))
                    line = rest
                bare.append(line)
                linked.append(share)
        first.append(len(bare))
    n_lines = len(bare)
    joined = MARK.join(bare)
    found = pa.array([MARK, *WORD.findall(joined.lower())], pa.string()).dictionary_encode()
    coded, words = found.indices.to_numpy()[1:].astype(np.int64), found.dictionary.to_pylist()  # the mark is 0
    n_words = len(words) + 1
    of_line = np.cumsum(coded == 0)
    raw, line = coded[coded > 0], of_line[coded > 0]
    number = np.array([w[0].isdigit() for w in words], bool)
    bits = np.array([_FUNCTION.get(w, 0) for w in words], np.int64)
    letters, script = np.array([ord(w[0]) for w in words]), np.full(len(words), len(SCRIPTS))
    for i, (lo, hi) in enumerate(SCRIPTS.values()):
        script[(letters >= lo) & (letters <= hi)] = i
    script[number] = -1
    size, first = np.bincount(line, minlength=n_lines)[:n_lines], np.array(first, np.int64)
    ends = np.r_[0, np.cumsum(size)]
    begins = ends[first]  # of the documents, in tokens
    total = np.diff(begins)
    doc = np.repeat(np.arange(len(texts)), total)
    langs, own, han = _languages(doc, raw, script, bits, len(texts))
    function = (bits[raw] & own[doc]) > 0
    is_number = number[raw]
    word = np.where(is_number, n_words, raw)
    stretches = np.maximum(1, total // STRETCH)
    stretch = np.r_[0, np.cumsum(stretches)[:-1]][doc] + np.minimum((np.arange(len(raw)) - begins[:-1][doc]) // STRETCH, stretches[doc] - 1)
    scaled = np.where(total >= 30, STRETCH / np.minimum(STRETCH, np.maximum(total, STRETCH // 3)), 1.0)

    def recurs(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
        """How often each key comes in its stretch, as a logarithm, scaled for short documents."""
        _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        return np.log1p((count[back] - 1) * scaled[of])

    def per_line(values: np.ndarray, where: np.ndarray) -> np.ndarray:
        return np.bincount(where, values, n_lines)

    single = recurs(stretch * (n_words + 1) + word, doc)
    content = ~is_number & ~function
    at = np.flatnonzero(line[1:] == line[:-1])  # tokens followed by one of the same line
    double = recurs((stretch[at] * (n_words + 1) + word[at]) * (n_words + 1) + word[at + 1], doc[at])
    telling = ~(is_number[at] & is_number[at + 1])

    starts = np.cumsum([len(x) + 1 for x in bare]) if bare else np.empty(0, np.int64)
    separators, prices, stops = (np.bincount(np.searchsorted(starts, at, "right"), minlength=n_lines)[:n_lines] for at in _signs(joined))
    neutral = np.where(han[:, None], NEUTRAL["han"], NEUTRAL["other"])[np.repeat(np.arange(len(texts)), np.diff(first))]
    numbers = per_line(is_number, line) / np.maximum(1, size)
    density = (
        LINK_WEIGHT * np.array(linked) * 5 / np.maximum(5, size) + separators / (size + WEIGHT) * (1 - numbers) ** 2 + PRICE_WEIGHT * prices / (size + 2)
    )
    features = np.stack([
        density,
        per_line(single[content], line[content]) / (per_line(content, line) + WEIGHT),
        per_line(double[telling], line[at][telling]) / (np.maximum(0, size - 1) + WEIGHT),
        (per_line(function, line) + neutral[:, 0] * WEIGHT) / (size + WEIGHT),
        (stops + neutral[:, 1] * WEIGHT) / (size + WEIGHT),
    ], 1) if n_lines else np.empty((0, len(FEATURES)))
    if n_lines:
        features[(size == 0) & (np.array(linked) == 0)] = np.nan
    return Measured(langs, first, np.array(chars, np.int64), features)


def _measured(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """A row per document: its lines as one array of structs, compact to keep and cheap to take apart."""
    kind = documents.schema[doc].dataType.simpleString()
    names = ["chars", *(f"f{j}" for j in range(len(FEATURES)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, (1,), DOCUMENTS):
                got = measure(batch.column(1).to_pylist())
                values = [pa.array(got.chars, pa.int32()), *(pa.array(got.features[:, j], pa.float32()) for j in range(len(FEATURES)))]
                lines = pa.ListArray.from_arrays(pa.array(got.first, pa.int32()), pa.StructArray.from_arrays(values, names))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.langs, pa.string()), lines], names=["d", "lang", "lines"])

    rows = documents.select(doc, text).filter(f"length(`{text}`) > 0")
    fields = ", ".join(["chars: int", *(f"f{j}: float" for j in range(len(FEATURES)))])
    return rows.mapInArrow(run, f"`{doc}` {kind}, lang string, lines array<struct<{fields}>>")


class Lines:
    """The lines of an Arrow batch of measured documents, as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        lists = batch.column(2)
        flat = lists.flatten()
        self.sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.langs = np.array(batch.column(1).to_pylist(), object)
        self.lang = np.repeat(self.langs, self.sizes)
        self.chars = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
        columns = [flat.field(j + 1).to_numpy(zero_copy_only=False) for j in range(len(FEATURES))]
        self.features = np.stack(columns, 1).astype(np.float64) if len(flat) else np.empty((0, len(FEATURES)))

    def per_document(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(self.sizes)), self.sizes), values, len(self.sizes)).astype(np.int64)


Model = tuple[np.ndarray, np.ndarray]


def _judged(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance of each line, and the share of it that points the way spam does."""
    z = x - model[0]
    parts = z * (z @ np.linalg.inv(model[1]))
    towards = z * np.array(TOWARDS) > 0
    return parts.sum(1), np.where(towards, np.maximum(parts, 0), 0).sum(1) / np.maximum(np.abs(parts).sum(1), 1e-9)


def _summed(measured: DataFrame, parts) -> dict[str, dict[int, float]]:
    """Sums over all lines: ``parts(features)`` gives places and values for each language of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, float]] = {}
        for batch in batches:
            lines = Lines(batch)
            for lang in set(lines.langs):
                own = total.setdefault(lang, {})
                x = lines.features[lines.lang == lang]
                for place, value in zip(*parts(lang, x[~np.isnan(x[:, 0])])):
                    own[place] = own.get(place, 0.0) + value
        flat = [(lang, place, value) for lang, own in total.items() for place, value in own.items()]
        columns = zip(*flat) if flat else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.float64()))], names=["lang", "place", "value"])

    rows = measured.mapInArrow(run, "lang string, place bigint, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    out: dict[str, dict[int, float]] = {}
    for lang, place, value in rows.collect():  # a fixed number of places per language
        out.setdefault(lang, {})[place] = value
    return out


#: The model of all lines, for scripts without any of their own.
ALL = ""


def robust_models(measured: DataFrame, steps: int = 3) -> dict[str, Model]:
    """Per language a robust location and scatter of the features of all its lines, and one for all languages.

    Medians and deviations come from counts per bin of a feature, a table of
    fixed size, exact to half a bin. Every script has an entry, ``?`` and its name,
    with the model of its commonest language.
    """
    p = len(FEATURES)
    told = measured.filter("lang not like '?%'")

    def bins(_: str, x: np.ndarray) -> tuple[list[int], list[float]]:
        place, count = np.unique(np.minimum((x / BIN).astype(np.int64), BINS - 1) + np.arange(p) * BINS, return_counts=True)
        return place.tolist(), count.astype(float).tolist()

    def median(values: np.ndarray, weights: np.ndarray) -> float:
        order = np.argsort(values)
        sums = np.cumsum(weights[order])
        return float(values[order][np.searchsorted(sums, sums[-1] / 2)]) if len(sums) else 0.0

    models, lines = {}, {}
    counted = _summed(told, bins)
    everything: dict[int, float] = {}
    for counts in counted.values():
        for place, count in counts.items():
            everything[place] = everything.get(place, 0.0) + count
    for lang, counts in (counted | {ALL: everything}).items():
        table = np.zeros((p, BINS))
        for place, count in counts.items():
            table[place // BINS, place % BINS] = count
        at = np.arange(BINS) * BIN
        centre = np.array([median(at[row > 0], row[row > 0]) for row in table])
        away = np.array([median(np.abs(at - c)[row > 0], row[row > 0]) for row, c in zip(table, centre)])
        models[lang] = centre, np.diag(np.square(np.maximum(1.4826 * away, BIN)) + RIDGE**2)
        lines[lang] = table[0].sum()
    own = {lang for lang in counted if lines[lang] >= LEAST_LINES}
    for _ in range(steps):
        known = models

        def moments(lang: str, x: np.ndarray, known=known, own=own) -> tuple[range, list[float]]:
            x = x[_judged(x, known[lang if lang in own else ALL])[0] <= CUT]
            return range(1 + p + p * p), [float(len(x)), *x.sum(0).tolist(), *(x.T @ x).ravel().tolist()]

        sums = {lang: np.array([s.get(j, 0.0) for j in range(1 + p + p * p)]) for lang, s in _summed(told, moments).items()}
        models = dict(known)
        for lang, s in [*((x, sums[x]) for x in sums if x in own), (ALL, sum(sums.values()))]:
            if np.ndim(s) and s[0]:
                mean = s[1 : 1 + p] / s[0]
                models[lang] = mean, s[1 + p :].reshape(p, p) / s[0] - np.outer(mean, mean) + np.eye(p) * RIDGE**2
    out = {f"?{script}": models[ALL] for script in SCRIPT_NAMES}
    for lang in sorted(own, key=lines.get):
        out[f"?{WORDS[lang][0]}"] = models[lang]  # the commonest comes last
    return {lang: out[f"?{WORDS[lang][0]}"] for lang in counted} | out | {lang: models[lang] for lang in own}


def spam_shares(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, lang, chars, spam_chars, spam_share)`` of every document with a line that isn't blank.

    ``lang`` is told from the text: a language, or ``?`` and a script. Null, empty and blank texts give no row. A
    document id that comes in several rows is taken as one document; a null id
    is kept. Other columns are ignored; an empty table gives an empty result.
    """
    measured = cut(_measured(documents, doc, text))
    models = robust_models(measured)
    kind = documents.schema[doc].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = Lines(batch)
            spam = np.zeros(len(lines.chars), bool)
            for lang in set(lines.langs):
                own = lines.lang == lang
                x = lines.features[own]
                away, directed = _judged(x, models[lang])
                spam[own] = (away > CUT) & (directed > DIRECTED)
            sums = [pa.array(lines.per_document(v)) for v in (lines.chars, lines.chars * spam)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sums], names=["d", "lang", "chars", "spam_chars"])

    shares = measured.mapInArrow(judge, f"`{doc}` {kind}, lang string, chars bigint, spam_chars bigint")
    shares = shares.groupBy(doc).agg(F.max("lang").alias("lang"), F.sum("chars").alias("chars"), F.sum("spam_chars").alias("spam_chars")).filter("chars > 0")
    return shares.withColumn("spam_share", F.col("spam_chars") / F.col("chars"))


def spam_documents(documents: DataFrame, doc: str = "doc_id", text: str = "text", share: float = 0.5) -> DataFrame:
    """Documents of which spam lines hold more than ``share`` of the characters; see :func:`spam_shares`."""
    return spam_shares(documents, doc, text).filter(F.col("spam_share") > share)
