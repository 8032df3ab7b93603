"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

Candidates are matches of one pattern for each kind. Those of the base kinds follow fixed rules and always stay. The
patterns of further kinds are wide on purpose: digit groups and pairs of capitalised words that are no personal data
match too and are the negatives. Three labelers vote yes, no or nothing on each: `regex` tests the shape strictly
(number plan, check digits, a title), `gazetteer` looks parts of it up in lists, `context` looks for cue words before it.

For each kind, a naive Bayes mixture of the votes is fitted by EM: the share of true candidates and each labeler's rates
of votes among true and false ones. `ANCHOR` imaginary candidates of either class, on which labelers are mostly right, keep
the classes apart where the corpus has few or one-sided candidates; twice as many false ones are expected as true ones. The probabilities are the targets of a logistic
regression, the final span classifier, whose features are the votes and what no labeler sees: the span's length and the
characters beside it. It also learns every pattern of votes at a small weight, so that patterns the corpus lacks are decided.

The corpus enters the fit as counts of patterns (kind, votes, shape), a table whose size depends on the labelers and
shapes alone; both fits run on it. Everything that touches a text is a column expression, in one narrow pass, so no key
can be hot.

Nulls and edges: a null text is an empty one; a null doc_id is kept; repeated rows are each answered; an empty table
gives no rows and a model that rejects; further columns are ignored. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from functools import partial
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odolith.llm.spans import found, let, written
from odolith.session import cut

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "local_phone", "ssn", "iban", "name")
LABELERS = ("regex", "gazetteer", "context")
FURTHER = KINDS[len(BASE):]
CONTEXT = 40
#: Imaginary candidates of each class in EM, the weight of each unseen vote pattern in the regression, and the most entries that a gazetteer table may have.
ANCHOR, UNSEEN, MOST_ENTRIES = 20.0, 0.5, 10_000

# Possessive repeats and look-behinds keep the matches of the plain patterns but walk long runs once.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?=[(0-9])(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?=[0-9])(?<![0-9-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9-])",
    "iban": r"(?=[A-Z])(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    "name": r"(?=\p{Lu})(?<![\p{L}.-])(?:(?:Mr|Mrs|Ms|Dr|Prof|Sr|Sra|Mme|Herr|Frau)\.?\x20)?\p{Lu}\p{Ll}++\x20\p{Lu}\p{Ll}++(?![\p{L}-])",
}
TITLE = r"^(?:Mr|Mrs|Ms|Dr|Prof|Sr|Sra|Mme|Herr|Frau)\.?\x20"

# Top-level domains, country prefixes, issuer prefixes, given names and cue words.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "ca", "us")
CALLING_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "64", "81", "86", "91")
ISSUERS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "60", "62", "64", "65")
# country and length of its account numbers
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22,
    "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
}
GIVEN_NAMES = tuple(
    "Adam Alan Albert Alejandro Alexander Alice Amanda Amy Ana Andrea Andreas Andrew Angela Ann Anna Anne Anthony Antoine Antonio Barbara Beatriz Benjamin Bernd Brian Camille Carl Carla "
    "Carlos Carmen Caroline Catherine Charles Charlotte Christian Christine Christopher Claire Claudia Daniel David Deborah Diana Diego Dorothy Edward Elena Elisabeth Elizabeth Emily Emma "
    "Eric Fernando Francisco Frank Frederic George Grace Hannah Hans Heinrich Helen Henri Henry Ines Isabel Isabelle Jack Jacob Jacques James Jan Jane Javier Jean Jennifer Jessica Jim Joan "
    "Johann John Jonas Jorge Jose Joseph Juan Julia Julie Karen Karl Katharina Kevin Klaus Laura Lena Linda Lisa Louis Louise Lucas Lucia Luis Manuel Margaret Maria Marie Mark Martin Mary "
    "Matthew Max Michael Michel Miguel Monika Nancy Nicolas Nicole Nina Olivia Pablo Patricia Patrick Paul Paula Pedro Peter Petra Philip Philippe Pierre Rachel Rafael Ramon Richard Robert "
    "Rosa Roger Ruth Sabine Samuel Sandra Sarah Sebastian Simon Sofia Sophie Stefan Stephen Steven Susan Susanne Teresa Thomas Tom Ursula Victor Walter William Wolfgang Yves".split()
)
LISTS = {"email": TOP_DOMAINS, "phone": CALLING_CODES, "card": ISSUERS, "iban": tuple(IBAN_LENGTHS), "name": GIVEN_NAMES}
CUES = {
    "email": "mail|contact|write to|address", "ip": "ip|host|server|addr", "card": "card|visa|master|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|contact", "local_phone": "phone|tel|call|mobile|fax|contact", "ssn": "ssn|social security|tax id",
    "iban": "iban|account|bank|konto|compte|cuenta", "name": "dear|signed|contact|author|patient|by",
}


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a string of digits holds."""

    def step(total: Column, i: Column) -> Column:
        d = F.substring(number, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), step) % 10 == 0


def small_parts(m: Column) -> Column:
    """Whether all four parts are at most 255, leading zeros or not."""
    return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255"))))


def base_rule(kind: str, m: Column) -> Column:
    if kind == "ip":
        return small_parts(m)
    if kind == "card":
        return let(digits(m), lambda d: F.length(d).between(16, 19) & F.when(F.length(d) <= 19, luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


def gate(kind: str, text: Column) -> Column:
    """A cheap test that fails where the kind's pattern cannot match."""
    mark = {"email": "@", "phone": "+"}.get(kind)
    return F.contains(text, F.lit(mark)) if mark else text.rlike(PATTERNS[kind])


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "y").when(no, "n").otherwise("-")


def regex_vote(kind: str, m: Column) -> Column:
    if kind == "email":
        return vote(m.rlike(r"^[A-Za-z0-9]+(?:[._+-][A-Za-z0-9]+)*+@(?:[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*+\.)+[A-Za-z]{2,}$"), m.rlike(r"@[0-9.]+$"))
    if kind == "ip":
        return vote(~m.rlike(r"(?:^|\.)0[0-9]"), m.rlike(r"^0+\.|(?:^|\.)0[0-9]"))
    if kind == "card":
        return vote(F.length(digits(m)) == 16, m.rlike("^0"))
    if kind == "phone":
        return vote(F.length(digits(m)).between(10, 13), m.rlike(r"\.\.|--|\x20\x20"))
    if kind == "local_phone":
        plan = m.rlike(r"^\(?[2-9][0-8][0-9]") & digits(m).rlike("^[0-9]{3}[2-9]")
        return vote(plan, ~plan)
    if kind == "ssn":
        void = m.rlike("^(?:000|666|9)|^[0-9]{3}.00|0000$")
        return vote(~void & m.contains("-"), void)
    if kind == "iban":
        return vote(iban_checks(m), ~iban_checks(m))
    return vote(m.rlike(TITLE), F.lit(False))


def iban_checks(m: Column) -> Column:
    """Whether the remainder by 97 is 1 once letters are numbers and the first four characters stand last."""

    def step(rest: Column, c: Column) -> Column:
        v = F.conv(c, 36, 10).cast("int")
        return (rest * F.when(v > 9, 100).otherwise(10) + v) % 97

    plain = F.regexp_replace(m, r"\x20", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    return (F.aggregate(F.split(turned, "(?!^)"), F.lit(0), step) == 1) & F.length(plain).between(15, 34)


def entries_of(table: DataFrame | None) -> dict[str, tuple[str, ...]]:
    """The lists of the gazetteer labeler: the built-in ones and those of a table (kind, entry), which has MOST_ENTRIES rows at most."""
    out = {k: set(v) for k, v in LISTS.items()}
    rows = table.select("kind", "entry").dropna().distinct().limit(MOST_ENTRIES + 1).collect() if table is not None else []
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a gazetteer has {MOST_ENTRIES} entries at most")
    for r in rows:
        out.setdefault(r.kind, set()).add(r.entry)
    return {k: tuple(sorted(v)) for k, v in out.items()}


def listed(x: Column, entries: Iterable[str]) -> Column:
    return F.array_contains(F.split(F.lit("\n".join(entries)), "\n"), x)


def gazetteer_vote(kind: str, m: Column, lists: dict[str, tuple[str, ...]]) -> Column:
    if kind == "ip":
        return vote(~m.rlike(r"^(?:10|127|0|255)\."), m.rlike(r"^(?:10|127|0|255)\."))
    if kind not in lists:
        return F.lit("-")
    if kind == "email":
        known = listed(F.lower(F.substring_index(m, ".", -1)), lists[kind])
    elif kind in ("card", "phone"):
        known = F.lit(False)
        for n in sorted({len(x) for x in lists[kind]}):
            known = known | listed(F.substring(digits(m), 1, n), [x for x in lists[kind] if len(x) == n])
    elif kind == "iban":
        known = listed(F.substring(m, 1, 2), lists[kind])
    elif kind == "name":
        known = listed(F.substring_index(F.regexp_replace(m, TITLE, ""), " ", 1), lists[kind])
    else:
        known = listed(m, lists[kind])
    return vote(known, ~known)


def context_vote(kind: str, text: Column, lo: Column) -> Column:
    before = F.lower(F.substring(text, F.greatest(lo - CONTEXT, F.lit(0)) + 1, F.least(lo, F.lit(CONTEXT))))
    return vote(before.rlike(rf"\b(?:{CUES[kind]})\b"), before.rlike(r"\b(?:version|page|figure|isbn|serial|invoice|order|part|model|chapter|street|city|river)\b"))


def side(c: Column) -> Column:
    """What a character beside a span is: an end of the text, a blank, a digit or letter, or another one."""
    return F.when(c == "", "e").when(c.rlike(r"^\s"), "b").when(c.rlike(r"^[\p{L}\p{N}]"), "w").otherwise("o")


def shape(text: Column, x: Column) -> Column:
    """Length in steps of four, up to 32, and what stands before and after the span."""
    before = F.when(x["lo"] > 0, F.substring(text, x["lo"], F.lit(1))).otherwise("")
    size = F.least(F.floor((x["hi"] - x["lo"]) / 4), F.lit(8)).cast("string")
    return F.concat(size, side(before), side(F.substring(text, x["hi"] + 1, F.lit(1))))


def outside(base: Column, span: Column) -> Column:
    return ~F.exists(base, lambda b: (b["lo"] < span["hi"]) & (span["lo"] < b["hi"]))


def candidates(text: Column, lists: dict[str, tuple[str, ...]] = LISTS) -> Column:
    """All candidate spans of a text: kind, lo, hi, the votes, one letter for each labeler, and the shape."""

    def of(kind: str) -> Column:
        hits = found(text, PATTERNS[kind], gate(kind, text), partial(base_rule, kind))
        return F.transform(hits, lambda x: F.struct(
            F.lit(kind).alias("kind"), x["lo"].alias("lo"), x["hi"].alias("hi"),
            F.concat(regex_vote(kind, x["m"]), gazetteer_vote(kind, x["m"], lists), context_vote(kind, text, x["lo"])).alias("votes"),
            shape(text, x).alias("shape"),
        ))

    base, further = (F.flatten(F.array(*[of(k) for k in KINDS if (k in BASE) == b])) for b in (True, False))
    # what lies in a base span is that span already
    return let(F.struct(base.alias("b"), further.alias("f")), lambda x: F.concat(x["b"], F.filter(x["f"], partial(outside, x["b"]))))


@dataclass(frozen=True)
class Model:
    """For each kind: prior, the share of true candidates; reliability[labeler][vote] = (P(vote | true), P(vote | false)). weights: those of the classifier by feature."""

    prior: dict[str, float]
    reliability: dict[str, list[dict[str, tuple[float, float]]]]
    weights: dict[str, float]

    def probability(self, kind: str, votes: str, shape: str = "") -> float:
        return 1 / (1 + math.exp(-sum(self.weights.get(f, 0.0) for f in features(kind, votes, shape))))

    def keeps(self, c: Column) -> Column:
        """Whether the classifier's probability of a candidate of a further kind is above one half."""
        weights = F.create_map(*[F.lit(x) for f, w in sorted(self.weights.items()) for x in (f, float(w))])
        parts = [F.lit("bias"), *(F.concat(F.lit(str(i)), F.substring(c["votes"], i + 1, 1)) for i in range(len(LABELERS)))]
        parts += [F.concat(F.lit(f"s{i}"), F.substring(c["shape"], i + 1, 1)) for i in range(3)]
        each = F.transform(F.array(*parts), lambda f: F.coalesce(F.try_element_at(weights, F.concat(c["kind"], F.lit(":"), f)), F.lit(0.0)))
        return F.aggregate(each, F.lit(0.0), lambda a, b: a + b) > 0


def features(kind: str, votes: str, shape: str = "") -> list[str]:
    return [f"{kind}:{f}" for f in ("bias", *(f"{i}{v}" for i, v in enumerate(votes)), *(f"s{i}{x}" for i, x in enumerate(shape)))]


def posterior(prior: float, reliability: list[dict[str, tuple[float, float]]], votes: str) -> float:
    yes, no = prior, 1 - prior
    for r, v in zip(reliability, votes):
        yes, no = yes * r[v][0], no * r[v][1]
    return yes / (yes + no)


#: A labeler's votes on true candidates as the anchor has them; those on false ones are the same with yes and no exchanged.
EXPECTED = {"y": 0.6, "n": 0.1, "-": 0.3}
OPPOSITE = {"y": "n", "n": "y", "-": "-"}


def expectation_maximisation(counts: dict[str, int], rounds: int = 100) -> tuple[float, list[dict[str, tuple[float, float]]]]:
    """Prior and reliabilities of the labelers from counts of vote patterns of one kind."""
    prior = 1 / 3
    reliability = [{v: (EXPECTED[v], EXPECTED[OPPOSITE[v]]) for v in EXPECTED} for _ in LABELERS]
    total = sum(counts.values())
    for _ in range(rounds):
        p = {v: posterior(prior, reliability, v) for v in counts}
        true = sum(n * p[v] for v, n in counts.items())
        prior = (true + ANCHOR) / (total + 3 * ANCHOR)
        for i in range(len(LABELERS)):
            own, other = defaultdict(float), defaultdict(float)
            for v, n in counts.items():
                own[v[i]] += n * p[v]
                other[v[i]] += n * (1 - p[v])
            rates = {x: ((own[x] + ANCHOR * EXPECTED[x]) / (true + ANCHOR), (other[x] + ANCHOR * EXPECTED[OPPOSITE[x]]) / (total - true + ANCHOR)) for x in EXPECTED}
            # a yes is never evidence against, nor a no for: where the counts say so, it is no evidence
            for x, wrong in (("y", rates["y"][0] < rates["y"][1]), ("n", rates["n"][0] > rates["n"][1])):
                if wrong:
                    rates[x] = (max(rates[x]), max(rates[x]))
            reliability[i] = rates
    return prior, reliability


def regression(rows: Iterable[tuple[list[str], float, float]], steps: int = 500, decay: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic regression on rows (features, target, weight)."""
    rows = list(rows)
    names = sorted({f for r in rows for f in r[0]})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, (held, _, _) in enumerate(rows):
        x[i, [at[f] for f in held]] = 1
    y, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    w = np.zeros(len(names))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        # Newton's step: there are a few dozen features
        slope = x.T @ (n * (y - p)) - decay * n.sum() * w
        curve = (x.T * (n * p * (1 - p))) @ x + (decay * n.sum() + 1e-9) * np.eye(len(names))
        step = np.linalg.solve(curve, slope)
        w = w + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(names, w.tolist()))


def fit_patterns(counts: dict[tuple[str, str, str], int]) -> Model:
    """EM over the votes of each kind, then the classifier. counts: (kind, votes, shape), a bounded number of rows."""
    prior, reliability, weights = {}, {}, {}
    for kind in KINDS:
        own = {k[1:]: n for k, n in counts.items() if k[0] == kind}
        votes: dict[str, int] = defaultdict(int)
        for (v, _), n in own.items():
            votes[v] += n
        prior[kind], reliability[kind] = expectation_maximisation(dict(votes))
        target = {"".join(v): posterior(prior[kind], reliability[kind], "".join(v)) for v in product("yn-", repeat=len(LABELERS))}
        # frequent patterns weigh more, but not so much that the others have no say
        rows = [(features(kind, v, s), target[v], math.sqrt(n)) for (v, s), n in sorted(own.items())]
        weights |= regression(rows + [(features(kind, v), p, UNSEEN) for v, p in target.items()])
    return Model(prior, reliability, weights)


def annotate(docs: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """docs with its candidates."""
    return docs.withColumn("candidates", candidates(F.coalesce(F.col("text"), F.lit("")), entries_of(gazetteer)))


def fit(annotated: DataFrame) -> Model:
    patterns = annotated.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.shape").count()
    return fit_patterns({(r.kind, r.votes, r["shape"]): r["count"] for r in patterns.collect()})


def decide(annotated: DataFrame, model: Model) -> DataFrame:
    """`spans`: candidates of base kinds, and the others that the classifier keeps."""
    return annotated.withColumn("spans", F.filter("candidates", lambda c: c["kind"].isin(*BASE) | model.keeps(c))).drop("candidates")


def find_pii(docs: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """doc_id and spans of every row."""
    annotated = cut(annotate(docs.select("doc_id", "text"), gazetteer).select("doc_id", "candidates"), "pii")
    return decide(annotated, fit(annotated))


def masked(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; of spans that overlap the first stands for all."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = F.concat(s["out"], F.substring(text, s["at"] + 1, x["lo"] - s["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(s["at"], x["hi"]).alias("at"), F.when(x["lo"] >= s["at"], fresh).otherwise(s["out"]).alias("out"))

    whole = let(F.aggregate(ordered, start, step), lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def of_kind(kind: str, span: Column) -> Column:
    return span["kind"] == kind


def digest(decided: DataFrame) -> DataFrame:
    """The report columns of find_pii(); candidates come in the order of kind, then start."""
    count = [F.size(F.filter("spans", partial(of_kind, k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return decided.select("doc_id", *count, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
