"""Personal data by weak supervision. DataFrame functions only.

Exact patterns give the base spans, which always stay. Looser patterns give further candidates: addresses that spell out
or bracket their marks, numbers parted in other ways. Four labelers vote on every candidate, each with yes, no or abstain:
the form (does the candidate, with its marks restored, meet the exact pattern's conditions), a gazetteer of what such data
looks like (top-level domains, issuers' digits, area codes), cue words nearby (for this kind, or only for another), and the
context that adjoins it. Expectation-maximisation over the counts of vote patterns (at most 81 a kind) estimates how
reliable every labeler is, without any gold label. The posteriors are the soft labels on which the final classifier, a
naive Bayes over features of the span, is trained, and the looser candidates that it accepts are added.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import durable

KINDS = ("email", "ip", "card", "phone")

# Base patterns. A match can only begin where a run of its first class begins or the last match ended, so the search
# begins nowhere else, and no quantifier gives back what it took: the matches are the same, and no text takes quadratic
# time or deep recursion.
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
BASE = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:\x20?(?:\(at\)|\[at\]|\{at\})\x20?|\x20at\x20|\x20@\x20)", r"(?:\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\x20dot\x20|\x20\.\x20|\.)"
_SEP = r"(?:\[\.\]|\(\.\)|\x20dot\x20|\.)"
LOOSE = {
    "email": _LOCAL + _AT + r"[A-Za-z0-9-]++(?:" + _DOT + r"[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\[\.\]|\(\.\)|\x20dot\x20)[0-9]{1,3}" + _SEP + r"[0-9]{1,3}" + _SEP + r"[0-9]{1,3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[._/]|\x20{2,3}|\x20[-–]\x20)[0-9]{4}(?:[._/]|\x20{2,3}|\x20[-–]\x20)[0-9]{4}(?:[._/]|\x20{2,3}|\x20[-–]\x20)[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}|00[1-9][0-9]{0,2}[\x20.-][0-9]{2,4}[\x20.-][0-9]{3,8}|0[1-9][0-9]{1,3}[/-][0-9]{5,8})(?![0-9])",
}
#: What a text must contain for a pattern to match at all.
NEEDS = {
    ("email", True): lambda t: t.contains("@"),
    ("ip", True): lambda t: t.rlike(r"[0-9]\.[0-9]"),
    ("card", True): lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    ("phone", True): lambda t: t.rlike(r"\+[0-9]"),
    ("email", False): lambda t: t.rlike(r"[(\[{]at[)\]}]|\x20at\x20[A-Za-z0-9-]+(?:\x20dot\x20|\.|\x20?[(\[{]dot)|\x20@\x20"),
    ("ip", False): lambda t: t.rlike(r"[0-9](?:[\[(]\.[\])]|\x20dot\x20)[0-9]"),
    ("card", False): lambda t: t.rlike(r"[0-9](?:[._/]|\x20{2,3}|\x20[-\u2013]\x20)[0-9]{4}"),
    ("phone", False): lambda t: t.rlike(r"[0-9][\x20.-][0-9]{3}|0[0-9]{2,4}[/-][0-9]"),
}
#: Whole words whose presence nearby speaks for a kind, in the languages of the corpus.
CUES = {
    "email": "e-?mails?|mails?|mailto|contact|correos?|courriels?|kontakt|adresse mail|write|escrib(?:e|ir|a)|schreib(?:en|t)",
    "ip": "ips?|hosts?|servers?|address(?:es)?|adresses?|direcci[oó]n|ping|router|gateway|subnet|dns",
    "card": "cards?|visa|mastercard|amex|cartes?|karten?|tarjetas?|payments?|credit|debit|kreditkarte|cvv",
    "phone": "phones?|tel|telephone|calls?|call|fax|mobile|cell|telefon|t[eé]l[eé]phone|tel[eé]fono|m[oó]vil|handy|whatsapp",
}
_WORD = r"(?<![\p{L}\p{N}_])(?:%s)(?![\p{L}\p{N}_])"
AGAINST = r"(?<![\p{L}\p{N}_])(?:versions?|ver\.|v|isbn|issn|doi|pages?|orders?|serial|build|sections?|tokens?|hash|invoice|chapter|fig(?:ure)?|ref(?:erence)?|bestellung|commande|pedido|seite)\W*$"
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|info|io|co|de|fr|es|it|uk|eu|us|ch|at|be|nl|biz|dev|app|example)$"
LABELERS = 4
ROUNDS = 30
ALPHA = 0.5  # weight of the first guess of each reliability
NO, YES, ABSTAIN = 0, 1, 2


def matches(text: Column, pattern: str, needs: Column) -> Column:
    """array<struct<start, txt, before, after>> of the leftmost non-overlapping matches, start in code points."""
    pattern_ = F.lit(pattern)
    both = F.when(needs, F.struct(F.regexp_extract_all(text, pattern_, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p")))

    def one(b: Column) -> Column:
        m, p = b["m"], b["p"]
        steps = F.transform(m, lambda x, i: F.length(F.get(p, i)) + F.when(i == 0, 0).otherwise(F.length(F.get(m, i - 1))))
        starts = F.aggregate(steps, F.expr("cast(array() as array<int>)"), lambda s, x: F.concat(s, F.array(F.coalesce(F.get(s, F.size(s) - 1), F.lit(0)) + x)))
        return F.transform(
            F.arrays_zip(m.alias("m"), starts.alias("s")),
            lambda z, i: F.struct(
                z["s"].alias("start"), z["m"].alias("txt"), F.right(F.get(p, i), F.lit(40)).alias("before"),
                F.left(F.get(p, i + 1), F.lit(20)).alias("after")
            ),
        )

    # A one-element array makes the two results a variable of the lambda, so that they are computed once.
    return F.coalesce(
        F.get(F.transform(F.array(both), lambda b: F.when(b.isNotNull(), one(b))), F.lit(0)),
        F.expr("cast(array() as array<struct<start:int,txt:string,before:string,after:string>>)")
    )


def _digits(txt: Column) -> Column:
    return F.regexp_replace(txt, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    n = F.length(digits)
    doubled = lambda d, i: F.when((n - i) % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    terms = F.transform(F.split(digits, ""), lambda c, i: doubled(c.try_cast("int"), i))
    return F.aggregate(F.filter(terms, lambda t: t.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets(txt: Column, separators: str) -> Column:
    parts = F.transform(F.split(txt, separators), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) < 4) & (p.try_cast("int") <= 255))


def valid(kind: str, txt: Column) -> Column:
    """The condition on a base match beyond its pattern."""
    n = F.length(_digits(txt))
    return {
        "email": F.lit(True),
        "ip": _octets(txt, r"\."),
        "card": (n >= 16) & (n <= 19) & luhn(_digits(txt)),
        "phone": (n >= 8) & (n <= 15),
    }[kind]


def _restored(txt: Column) -> Column:
    """An address with its marks as they are meant."""
    at = F.regexp_replace(txt, r"\x20?(?:\(at\)|\[at\]|\{at\})\x20?|\x20at\x20|\x20@\x20", "@")
    return F.regexp_replace(at, r"\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\x20dot\x20|\x20\.\x20", ".")


def _form(kind: str, txt: Column) -> Column:
    """First labeler, on a looser candidate: whether it meets the exact pattern's conditions once its marks are restored.

    Words and blanks that stand for marks are also plain words and blanks: they count as marks before a known domain only.
    """
    n = F.length(_digits(txt))
    exact = _restored(txt).rlike("^" + BASE["email"].replace(r"(?:\G|(?<![A-Za-z0-9._%+-]))", "") + "$")
    marked = txt.rlike(r"[(\[{]at[)\]}]") | _restored(txt).rlike(DOMAINS)
    return {
        "email": F.when(exact & marked, YES).otherwise(NO),
        "ip": F.when(_octets(txt, r"[^0-9]+"), YES).otherwise(NO),
        "card": F.when((n == 16) & luhn(_digits(txt)), YES).otherwise(NO),
        "phone": F.when((n < 8) | (n > 15), NO).when(n.between(9, 13), YES).otherwise(ABSTAIN),
    }[kind]


def _listed(kind: str, txt: Column) -> Column:
    """Second labeler: what a gazetteer says. It abstains where a span has nothing that could be listed."""
    n, digits = F.length(_digits(txt)), _digits(txt)
    area = F.regexp_replace(digits, "^(?:00)?1(?=[0-9]{10}$)", "")
    return {
        "email": F.when(_restored(txt).rlike(DOMAINS), YES).otherwise(NO),
        "ip": F.when(txt.rlike(r"^0(?![0-9])|(?:^|[^0-9])0[0-9]"), NO).when(txt.rlike(r"^(?:10|127|172|192)(?![0-9])"), YES).otherwise(ABSTAIN),
        "card": F.when(txt.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"), YES).when(txt.rlike("^[0-17-9]"), NO).otherwise(ABSTAIN),
        "phone": F.when(txt.rlike(r"^(?:\+|00)[1-9]"), YES).when(
            (n == 10) & area.rlike("^[2-9][0-9]{2}[2-9]"), YES
        ).when((n == 10) & area.rlike("^[01]{2}"), NO).otherwise(ABSTAIN),
    }[kind]


def candidates(text: Column, kind: str, base: bool) -> Column:
    """array<struct<kind, start, stop, base, votes, features>>"""
    found = matches(text, (BASE if base else LOOSE)[kind], NEEDS[kind, base](text))
    if base:
        found = F.filter(found, lambda m: valid(kind, m["txt"]))

    def described(m: Column) -> Column:
        around = F.lower(F.concat_ws(" ", m["before"], m["after"]))
        cue = around.rlike(_WORD % CUES[kind])
        other = around.rlike(_WORD % "|".join(c for k, c in CUES.items() if k != kind)) & ~cue
        joined = m["before"].rlike(r"[\p{L}0-9_]$") | m["after"].rlike(r"^[\p{L}0-9_]")
        against = F.lower(m["before"]).rlike(AGAINST)
        parted = (m["before"] == "") | m["before"].rlike(r"[\s(:;,<\"'=\[]$")
        form, listed = F.lit(YES) if base else _form(kind, m["txt"]), _listed(kind, m["txt"])
        about = F.when(cue, YES).when(other, NO).otherwise(ABSTAIN)
        votes = F.array(form, listed, about, F.when(against | joined, NO).when(parted, YES).otherwise(ABSTAIN))
        n = F.length(m["txt"])
        feature = lambda name, value: F.concat(F.lit(f"{name}:"), value.cast("string"))
        features = F.array(
            feature("form", form),
            feature("listed", listed),
            feature("about", about),
            feature("joined", joined),
            feature("against", against),
            feature("length", F.least(F.floor(n / 6), F.lit(6))),
            feature("left", F.when(m["before"].rlike(r"[\s]$"), "space").when(m["before"] == "", "edge").otherwise("mark")),
        )
        own = F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), (m["start"] + n).alias("stop"))
        return F.struct(
            own["kind"].alias("kind"), own["start"].alias("start"), own["stop"].alias("stop"), F.lit(base).alias("base"), votes.alias("votes"),
            features.alias("features")
        )

    return F.transform(found, described)


def reliabilities(patterns: DataFrame) -> DataFrame:
    """(kind, votes, q): the posterior of a true span for every vote pattern, by EM within each kind.

    patterns: (kind, votes, n). One row a kind holds its at most 3**4 patterns, and the rounds are a fold over them, so
    the whole estimation is one expression. theta holds, for spans that are true and for those that are not, the chance
    of each vote of each labeler; the first guess is that labelers are right more often than not.
    """
    per_kind = patterns.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("ps"))
    guess = {True: {NO: 0.1, YES: 0.8, ABSTAIN: 0.1}, False: {NO: 0.8, YES: 0.1, ABSTAIN: 0.1}}
    start = lambda true: "array(" + ",".join("array(" + ",".join(f"{guess[true][v]}D" for v in range(3)) + ")" for _ in range(LABELERS)) + ")"
    likely = lambda theta: " * ".join(f"s.{theta}[{i}][p.votes[{i}]]" for i in range(LABELERS))
    posterior = f"(s.prior * {likely('t1')}) / (s.prior * {likely('t1')} + (1D - s.prior) * {likely('t0')})"
    weight = lambda q: f"aggregate(x, 0D, (a, y) -> a + y.n * {q})"
    share = lambda q, true: (
        "array(" + ",".join(
            "array(" + ",".join(
                f"(aggregate(x, 0D, (a, y) -> a + if(y.votes[{i}] = {v}, y.n * {q}, 0D)) + {ALPHA * 10 * guess[true][v]}D) / ({weight(q)} + {ALPHA * 10}D)" for v in range(3)
            ) + ")"
            for i in range(LABELERS)
        ) + ")"
    )
    step = (
        f"transform(array(transform(ps, p -> struct(p.votes as votes, p.n as n, {posterior} as q))), x -> "
        f"named_struct('prior', ({weight('y.q')} + {ALPHA}D) / ({weight('1D')} + {2 * ALPHA}D), 't1', {share('y.q', True)}, 't0', {share('(1D - y.q)', False)}))[0]"
    )
    fitted = per_kind.select(
        "kind", "ps",
        F.expr(f"aggregate(sequence(1, {ROUNDS}), named_struct('prior', 0.5D, 't1', {start(True)}, 't0', {start(False)}), (s, r) -> {step})").alias("s")
    )
    return fitted.select("kind", F.expr(f"explode(transform(ps, p -> struct(p.votes as votes, {posterior} as q)))").alias("e")).select("kind", "e.votes", "e.q")


def train(found: DataFrame) -> dict[str, float]:
    """Log odds of the final classifier by 'kind|feature', and by 'kind' alone the prior's.

    found: (cands). All candidates of the corpus are counted; the tables are bounded by the vote patterns and features.
    """
    each = found.select(F.explode("cands").alias("c")).select("c.kind", "c.votes", "c.features")
    counted = durable(each.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")), "pii-counts")
    soft = counted.join(F.broadcast(reliabilities(counted.groupBy("kind", "votes").agg(F.sum("n").alias("n")))), ["kind", "votes"])
    keyed = soft.select("kind", "q", "n", F.explode(F.concat(F.array(F.lit("")), "features")).alias("feature"))
    sums = keyed.groupBy("kind", "feature").agg(F.sum(F.col("n") * F.col("q")).alias("yes"), F.sum(F.col("n") * (1 - F.col("q"))).alias("no")).collect()
    total = {r["kind"]: (r["yes"] + 1, r["no"] + 1) for r in sums if not r["feature"]}
    odds = {}
    for r in sums:
        yes, no = total[r["kind"]]
        odds[f"{r['kind']}|{r['feature']}"] = log(yes / no) if not r["feature"] else log((r["yes"] + 1) / (yes + 1)) - log((r["no"] + 1) / (no + 1))
    return odds


def _overlaps(c: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < c["stop"]) & (c["start"] < o["stop"]))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added (arrays of kind, start, stop) for every row of docs; kind is a number in KINDS.

    Added spans are candidates of the looser patterns that overlap no base span and that the final classifier gives a
    chance of at least one half. Offsets are code points of the whole text, ends exclusive. Null texts count as empty.
    Rows are handled each, whatever their ids; other columns are ignored; without candidates nothing is trained.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    base = F.concat(*[candidates(F.col("text"), k, True) for k in KINDS])
    loose = F.concat(*[candidates(F.col("text"), k, False) for k in KINDS])
    raw = own.select("doc_id", base.alias("base"), loose.alias("loose"))
    found = durable(raw.select("doc_id", F.concat("base", F.filter("loose", lambda c: ~_overlaps(c, F.col("base")))).alias("cands")), "pii-candidates")
    odds = train(found.where(F.size("cands") > 0))
    weights = F.create_map(*[x for k, v in odds.items() for x in (F.lit(k), F.lit(v))]) if odds else F.expr("cast(map() as map<string, double>)")
    weigh = lambda c, f: F.coalesce(F.try_element_at(weights, F.concat(c["kind"].cast("string"), F.lit("|"), f)), F.lit(0.0))
    score = lambda c: F.aggregate(c["features"], weigh(c, F.lit("")), lambda s, f: s + weigh(c, f))
    bare = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"))
    return found.select(
        "doc_id",
        F.transform(F.filter("cands", lambda c: c["base"]), bare).alias("base"),
        F.transform(F.filter("cands", lambda c: ~c["base"] & (score(c) >= 0)), bare).alias("added"),
    )


def listed(spans: Column) -> Column:
    """kind:start:end by kind as in KINDS, then start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))),
        ","
    )


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(F.encode(listed(F.col("base")), "utf-8"), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
    )


def masked(docs: DataFrame, found: DataFrame | None = None, mark: str = "█", *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all their columns, and a text in which every code point of a span is mark.

    Without found, spans are looked for in docs themselves and rows travel whole, so ids may be null or repeat with any
    texts. found is what find() returned for docs in which an id has one text; rows may repeat in either. A null text stays
    null; other columns are carried, whatever their names.
    """
    whole = F.struct("*")
    if found is None:
        rows = docs.select(F.struct(whole.alias("row")).alias("_row"), F.col(text_col).alias("_text"))
        both = find(rows, id_col="_row", text_col="_text").select(F.col("doc_id.row").alias("row"), F.concat("base", "added").alias("spans"))
    else:
        spans = found.select(F.col("doc_id").alias("_id"), F.concat("base", "added").alias("spans")).distinct()
        rows = docs.select(whole.alias("row"), F.col(id_col).alias("_of"))
        both = rows.join(spans, F.col("_of").eqNullSafe(F.col("_id")), "left").withColumn("spans", F.coalesce("spans", F.array()))
    size = lambda s: (s["stop"] - s["start"]).cast("int")
    hide = lambda t, s: F.overlay(t, F.repeat(F.lit(mark), size(s)), s["start"] + 1, size(s))
    hidden = F.aggregate("spans", F.col("row").getField(text_col), hide)
    return both.select(*[hidden.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
