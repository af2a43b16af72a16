"""Personal data by weak supervision.

Patterns propose candidate spans. Labelers vote on each: strict forms, gazetteers and
words of the context, each for, against or silent. Expectation-maximisation over the
counts of vote patterns in all documents estimates how reliable each labeler is. Its soft
labels train the span classifier, which never sees a vote: it judges by the word before,
the letters' shape, what follows, length, place and checksum, so it also decides where
all labelers are silent. Only the table of vote patterns and that of the classifier's
features, both of a bounded number of rows, come to the driver; what is written between
the steps holds places, never the data found.
"""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chimerascope.llm.shared import scratch
from chimerascope.llm.spans import clear_of, count_kind, digest_text, digits, find, let, passes_luhn, pieces, places, valid_address, window

# Kinds, the base ones first, in the order that breaks ties.
KINDS = ("email", "ip", "card", "phone", "local_phone", "ssn", "iban", "written_email", "person", "street")
BASE = 4

_LOCAL = "[A-Za-z0-9._%+-]"
# No start within a run that failed from its first character; after a match the next run starts where the match ended.
_EMAIL = f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
_IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
_CARD = "[0-9](?:[\\x20-]?+[0-9])++"
_PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
_FURTHER = (
    ("local_phone", "(?<![0-9+.)(-])(?<![0-9+.)(-]\\x20)(?:\\([0-9]{3}\\)\\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])"),
    ("ssn", "(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", "(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){3,7}(?:\\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])"),
    ("written_email", "(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64}+\\x20?[(\\[]at[)\\]]\\x20?[A-Za-z0-9-]{1,63}+\\x20?(?:[(\\[]dot[)\\]]|\\.)\\x20?[A-Za-z]{2,12}(?![A-Za-z])"),
    ("person", "(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\\.?\\x20[A-Z][a-z]{1,20}(?:\\x20[A-Z][a-z]{1,20}){0,2}(?![a-z])"),
    ("street", "(?<![0-9])[0-9]{1,5}\\x20(?:[A-Z][a-z]{1,20}\\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard)(?![A-Za-z])"),
)

# Gazetteers and words of the context, by hand.
_DOMAINS = (
    "(?:com|org|net|edu|gov|mil|int|info|biz|io|dev|app|ai|me|tv|co|name|pro|eu|uk|us|ca|mx|br|ar|cl|pe|de|at|ch|li|fr|be|nl|lu|es|pt|it|gr|ie|is|no|se|dk|fi|ee|lv|lt|pl|cz|sk|hu|ro|bg|hr|si|rs|"
    "ua|ru|tr|il|ae|sa|eg|za|ng|ke|in|pk|cn|hk|tw|jp|kr|sg|my|th|vn|id|ph|au|nz)"
)
_GIVEN = (
    "james john robert michael william david richard joseph thomas charles daniel matthew anthony mark paul steven andrew kenneth george joshua kevin brian edward ronald timothy jason mary patricia jennifer linda "
    "elizabeth barbara susan jessica sarah karen nancy lisa margaret sandra ashley emily anna laura julia emma olivia sophia maria hans peter klaus jürgen wolfgang stefan heike sabine petra monika pierre jean "
    "michel philippe nicolas marie nathalie isabelle carlos josé juan luis antonio carmen ana lucía giovanni marco giulia ahmed mohammed fatima wei li ming yuki hiroshi priya raj olga ivan"
).split()
_SURNAMES = (
    "smith johnson williams brown jones garcia miller davis rodriguez martinez hernandez lopez gonzalez wilson anderson taylor moore jackson martin lee perez thompson white harris clark lewis robinson walker young "
    "allen king wright scott nguyen hill green adams baker müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann dubois durand lefebvre moreau laurent rossi russo ferrari fernández gómez silva "
    "santos kim chen wang zhang singh kumar ali khan ivanov kowalski novak jensen hansen"
).split()
_NAMES = "(?i)(?<!\\p{L})(?:" + "|".join((*_GIVEN, *_SURNAMES)) + ")(?!\\p{L})"
_BANKS = "^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|SE)"
_FOR = "(?i)(?:e-?mail|mail|contact|call|phone|tel|mobile|fax|ssn|social security|iban|account|card|visa|mastercard|credit|ip|host|address|lives|born|dear|name)"
_AGAINST = "(?i)(?:version|release|isbn|issn|doi|order|invoice|sku|part no|model|chapter|section|page|figure|table|example|serial)"
#: Code points of context read on each side of a span.
CONTEXT = 40
#: How many traits the classifier sees, and how many values of each; words and shapes are hashed to so many.
TRAITS, TRAIT_VALUES = 6, 256
LABELERS = ("form", "gazetteer", "context_for", "context_against", "plain", "company")


def base_spans(text: Column) -> Column:
    """Valid spans of the base kinds, sorted by start and kind."""
    n = lambda s: F.length(digits(s["hit"]))
    return F.sort_array(
        F.concat(
            find(text, _EMAIL, 0, gate=F.contains(text, F.lit("@"))),
            F.filter(find(text, _IP, 1), lambda s: valid_address(s["hit"])),
            F.filter(find(text, _CARD, 2), lambda s: passes_luhn(s["hit"], 12, 19)),
            F.filter(find(text, _PHONE, 3, gate=F.contains(text, F.lit("+"))), lambda s: n(s).between(9, 15)),
        )
    )


def _further_spans(text: Column, base: Column) -> Column:
    """Candidates of the further kinds that don't overlap a base span."""
    return clear_of(F.concat(*[find(text, pattern, KINDS.index(kind)) for kind, pattern in _FURTHER]), base)


def _fields(s: Column) -> list[Column]:
    return [s[name].alias(name) for name in ("start", "kind", "end")]


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(parts: Column, spans: Column) -> Column:
    """Of the text whose pieces parts are: the place of each span with its votes (1 for, -1 against, 0 silent) in the order of LABELERS, and its traits."""

    def judged(s: Column, i: Column) -> Column:
        hit, kind = s["hit"], s["kind"]
        before = window(parts, F.greatest(s["start"] - CONTEXT, F.lit(0)), F.least(s["start"], F.lit(CONTEXT)))
        after = window(parts, s["end"], F.lit(CONTEXT // 2))
        number = digits(hit)
        is_kind = lambda *names: kind.isin(*[KINDS.index(x) for x in names])
        form_no = is_kind("ssn") & hit.rlike("^(?:000|666|9)|-00-|-0000$") | is_kind("local_phone") & number.rlike("^[01]")
        form_yes = is_kind("email", "ip", "card", "phone", "ssn") | is_kind("local_phone") & number.rlike("^[2-9][0-9]{2}[2-9]")
        gazetteer_yes = (
            is_kind("email", "written_email") & hit.rlike(f"(?i)[^a-z]{_DOMAINS}$")
            | is_kind("iban") & hit.rlike(_BANKS)
            | is_kind("person", "street") & hit.rlike(_NAMES)
            | is_kind("card") & number.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)")
        )
        near = lambda t: F.when(t.isNotNull(), (t["start"] < s["end"] + 80) & (t["end"] > s["start"] - 80)).otherwise(False)
        company = near(F.get(spans, i - 1)) | near(F.get(spans, i + 1))
        repeated = (F.length(number) > 0) & F.regexp_replace(number, "^(.)\\1*$", "").eqNullSafe("")
        votes = F.array(
            _vote(form_yes & ~form_no, form_no),
            _vote(gazetteer_yes, F.lit(False)),
            _vote(before.rlike(_FOR), F.lit(False)),
            _vote(F.lit(False), before.rlike(_AGAINST)),
            _vote(after.rlike("^[\\x20\\n.,;:!?)]|^$"), repeated),
            _vote(company, F.lit(False)),
        )
        return F.struct(*_fields(s), votes.alias("votes"), _traits(kind, hit, before, after, s["start"]).alias("traits"))

    return F.transform(spans, judged)


def _traits(kind: Column, hit: Column, before: Column, after: Column, start: Column) -> Column:
    """What the classifier sees of a span, as whole numbers of at most TRAIT_VALUES each: length class, shape, word before, sign after, place in the text, checksum."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(hit, "[0-9]+", "9"), "\\p{Lu}+", "A"), "\\p{Ll}+", "a"), "(9[.\\x20-]?|Aa\\x20?){3,}", "*")
    word = F.lower(F.regexp_extract(before, "(\\p{L}+)[^\\p{L}]*$", 1))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(TRAIT_VALUES)).cast("int")
    length = F.least(F.floor(F.log2(F.length(hit).cast("double"))), F.lit(9)).cast("int")
    place = F.when(start == 0, 0).when(before.rlike("[.!?\\n]\\x20*$"), 1).otherwise(2)
    return F.array(length, bucket(shape), bucket(word), bucket(F.regexp_extract(after, "^(\\p{L}+|.)", 1)), place, F.when(kind == KINDS.index("iban"), F.when(sound_iban(hit), 1).otherwise(0)).otherwise(2))


def sound_iban(hit: Column) -> Column:
    """Whether an account number leaves 1 when divided by 97, its first four signs moved to the end and letters read as numbers from 10."""
    bare = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, F.length(bare)), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = lambda acc, c: F.when(value(c) > 9, (acc * 100 + value(c)) % 97).otherwise((acc * 10 + value(c)) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda acc, c: rest(acc, c).cast("int")) == 1


def candidates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, and the base and further spans as places, each with its votes and traits."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text"))
    spans = let(base_spans(F.col("text")), lambda base: F.sort_array(F.concat(base, _further_spans(F.col("text"), base))))
    both = F.struct(spans.alias("spans"), pieces(F.col("text")).alias("pieces"))
    return rows.select("doc_id", let(both, lambda x: _votes(x["pieces"], x["spans"])).alias("spans"))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 30) -> dict[tuple[int, tuple[int, ...]], float]:
    """Probability of being personal data for each kind and vote pattern, by expectation-maximisation.

    patterns: kind, votes, count. Labelers are taken to vote independently given the truth; each has
    its own rates of the three votes for either truth, and each kind its own prior.
    """
    counts = {(kind, votes): n for kind, votes, n in patterns}
    chance = {(kind, votes): 1 / (1 + math.exp(-0.5 - sum(votes))) for kind, votes in counts}
    labelers = len(next(iter(counts), (0, ()))[1])
    for _ in range(rounds):
        rate = {}
        for truth in (0, 1):
            part = {k: n * (chance[k] if truth else 1 - chance[k]) for k, n in counts.items()}
            whole = sum(part.values())
            for j in range(labelers):
                for vote in (-1, 0, 1):
                    # A little weight on voting with the truth keeps the two classes from changing places.
                    prior = 2.0 if vote == (1 if truth else -1) else 1.0
                    rate[truth, j, vote] = (sum(v for (_, votes), v in part.items() if votes[j] == vote) + prior) / (whole + 4.0)
        prior_of = {}
        for kind in {k for k, _ in counts}:
            own = [(n, chance[k, v]) for (k, v), n in counts.items() if k == kind]
            prior_of[kind] = (sum(n * c for n, c in own) + 1) / (sum(n for n, _ in own) + 2)
        for kind, votes in counts:
            odds = math.log(prior_of[kind] / (1 - prior_of[kind]))
            odds += sum(math.log(rate[1, j, v] / rate[0, j, v]) for j, v in enumerate(votes))
            chance[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return chance


def vote_patterns(table: DataFrame) -> DataFrame:
    """(kind, votes, n): at most kinds x 3 ** labelers rows, however large the table."""
    return table.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").agg(F.count("*").alias("n"))


def _numbers(values: list[float]) -> Column:
    """A constant array, of which an element is read by its place."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _code(kind: int, votes: tuple[int, ...]) -> int:
    for vote in votes:
        kind = 3 * kind + vote + 1
    return kind


def trait_weights(table: DataFrame, chance: dict[tuple[int, tuple[int, ...]], float]) -> list[float]:
    """Log-odds weights of a naive Bayes classifier over the traits of each kind, trained on the soft labels of all spans.

    One for each kind, trait and value; the first trait has the kind's own odds as its
    value 0. Kinds and traits without spans weigh nothing.
    """
    labels = [0.5] * len(KINDS) * 3 ** len(LABELERS)
    for pattern, p in chance.items():
        labels[_code(*pattern)] = p
    code = F.aggregate("s.votes", F.col("s.kind"), lambda acc, v: (3 * acc + v + 1).cast("int"))
    spans = table.select(F.explode("spans").alias("s")).select("s.kind", "s.traits", F.get(_numbers(labels), code).alias("p"))
    seen = spans.select("kind", "p", F.posexplode(F.concat(F.array(F.lit(0)), "traits")).alias("trait", "value"))
    rows = seen.groupBy("kind", "trait", "value").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    whole = {r["kind"]: (r["yes"], r["no"]) for r in rows if r["trait"] == 0}
    weights = [0.0] * len(KINDS) * (1 + TRAITS) * TRAIT_VALUES
    for r in rows:
        yes, no = whole[r["kind"]]
        own = math.log((yes + 1) / (no + 1)) if r["trait"] == 0 else math.log((r["yes"] + 1) / (yes + 2)) - math.log((r["no"] + 1) / (no + 2))
        weights[(r["kind"] * (1 + TRAITS) + r["trait"]) * TRAIT_VALUES + r["value"]] = own
    return weights


def detect(docs: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, base and spans (arrays of start, kind, end).

    Whole texts are searched, offsets count code points. Base spans always stay; a further
    span stays where the classifier's probability reaches threshold. Null and empty texts
    have no spans. Repeated rows give repeated result rows; doc_id is passed on as it is,
    null too; other columns are left out. An empty table gives no rows.
    """
    table = scratch(candidates(docs), "pii-candidates")
    weights = trait_weights(table, reliabilities([(r["kind"], tuple(r["votes"]), r["n"]) for r in vote_patterns(table).collect()]))
    lookup = _numbers(weights)

    def odds(s: Column) -> Column:
        first = s["kind"] * (1 + TRAITS) * TRAIT_VALUES
        return F.aggregate(F.transform(s["traits"], lambda v, i: F.get(lookup, first + (i + 1) * TRAIT_VALUES + v)), F.get(lookup, first), lambda a, w: a + w)

    bound = math.log(threshold / (1 - threshold))
    kept = F.filter("spans", lambda s: (s["kind"] < BASE) | (odds(s) >= bound))
    return table.select("doc_id", places(F.filter("spans", lambda s: s["kind"] < BASE)).alias("base"), places(kept).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of docs."""
    return detect(docs).select(
        "doc_id",
        *[count_kind(F.col("base"), i).alias(f"n_{kind}") for i, kind in enumerate(KINDS[:BASE])],
        F.sha2(digest_text(F.col("base"), KINDS), 256).alias("base_sha256"),
        digest_text(F.col("spans"), KINDS).alias("spans"),
    )
