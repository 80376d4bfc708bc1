"""Personal data by weak supervision, as expressions only.

Base spans come from four validated patterns. Beyond them, wider patterns find
candidates of five kinds: secrets, numbers that look like phone numbers without a plus
sign, identity numbers, bank accounts and names with a title. On each candidate, and on
each match of a base pattern, valid or not, three labelers vote: a regex (the strict
shape of the kind, or its check digits), a gazetteer of words that announce the kind,
and the context right before it. Expectation-maximisation over the counts of vote
patterns estimates how often each labeler is right, and how common each kind is; its
posteriors train the final span classifier, a naive Bayes over kind, votes and shape. Both
run on a table of at most len(CODES) * 2 ** len(FEATURES) rows. A candidate with a
probability over 0.5 that overlaps no base span becomes a span; of candidates that
overlap each other the first stays, of those that begin together the longest.

Patterns are written with possessive repeats, so that Java matches them in loops
and in time linear in the text; they find the same matches as the plain ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, materialise, table, whole

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "id", "account", "name")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap conditions without which a pattern has no valid match.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}

_KEY = r"[A-Za-z0-9_+/-]"
_PASS = "(?:[Pp]ass(?:word|wd|wort|phrase)|PASSWORD|[Pp]wd|[Cc]ontraseña|[Cc]lave)"


def _secret_signs(text: Column) -> Column:
    """A digit beside another character of a key, or a part of what announces a password or a private key."""
    out = text.rlike("[0-9]") & text.rlike("[0-9][A-Za-z_+/-]|[A-Za-z_+/-][0-9]")
    for part in ("assw", "assph", "PASSW", "pwd", "Pwd", "ontrase", "lave", "PRIVATE KEY"):
        out = out | text.contains(part)
    return out


#: kind: (the kind in KINDS of its spans, pattern, guard: a cheap pattern or condition without which there is no match). The lookbehinds
#: of a pattern see text, not its other matches.
CANDIDATES = {
    "secret": ("secret", rf"(?<!{_KEY})(?={_KEY}{{0,256}}[0-9])(?={_KEY}{{0,256}}[A-Za-z]){_KEY}{{12,}}+={{0,2}}|(?<={_PASS}\x20{{0,2}}[:=]\x20{{0,2}}[\"']{{0,1}})[^\s\"']{{6,}}+|-----BEGIN [A-Z ]{{0,32}}PRIVATE KEY-----", _secret_signs),
    "number": ("phone", r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])", r"[0-9][\x20.-][0-9]"),
    "id": ("id", r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{1,2}[0-9]{6,9}[A-Z]?|[0-9]{8}-?[A-Z])(?![0-9A-Za-z-])", "[0-9]{4}"),
    "account": ("account", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![0-9A-Za-z])", "[A-Z]{2}[0-9]{2}"),
    "name": ("name", r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Señor|Señora|Sra?)\.?\x20\p{Lu}\p{Ll}++(?:[\x20-]\p{Lu}\p{Ll}++){0,2}", r"[MDPHFS](?:rs?|s|rof|err|rau|me|lle|ra|eñora?)\.?\x20\p{Lu}"),
}
CODES = (*BASE, *CANDIDATES)
#: Words that announce a kind, in the languages of the tables.
GAZETTEER = {
    "email": ("email", "e-mail", "mail", "correo", "courriel", "contact"),
    "ip": ("ip", "host", "server", "address", "client", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "kreditkarte", "carte", "tarjeta"),
    "phone": ("phone", "telephone", "tel", "mobile", "cell", "fax", "whatsapp", "telefon", "teléfono", "téléphone", "rufnummer", "móvil"),
    "secret": ("token", "key", "apikey", "api_key", "secret", "password", "passwd", "pwd", "bearer", "credential", "credentials", "passphrase", "passwort", "schlüssel", "contraseña", "clave", "jeton", "clé"),
    "id": ("ssn", "social security", "passport", "licence", "license", "ausweis", "personalausweis", "reisepass", "dni", "nif", "nie", "passeport", "pasaporte"),
    "account": ("iban", "account", "konto", "kontonummer", "compte", "cuenta", "bank"),
    "name": ("name", "named", "signed", "contact", "from", "dear", "nombre", "nom", "unterschrift", "cher", "estimado"),
}
GAZETTEER["number"] = GAZETTEER["phone"]
#: What stands right before a value that is given: a sign, or a verb of asking.
CONTEXT = r"(?i)(?:[:=]\s{0,2}[\"'(<]{0,1}|(?:call|reach|dial|text|contact|number|is|ist|es|est|nummer|número|numéro|appelez|llame)\W{1,3}(?:\p{L}+\W{1,3}){0,2}[\"'(<]{0,1})$"
STRICT = {
    "secret": r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/-]{20,}={0,2}$|PRIVATE KEY",
    "number": r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$",
    "id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "name": r"\p{Lu}\p{Ll}+[\x20-]\p{Lu}\p{Ll}+$",
}
FEATURES = ("regex", "gazetteer", "context", "quoted", "long", "digits")
VOTERS = 3
#: Characters before a match that the labelers see.
BEFORE = 40
#: Matches that are placed in one go.
_RUN = 128


def _luhn(digits: Column) -> Column:
    def add(acc, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _mod_97(account: Column) -> Column:
    """The check of an international account number: its country and check digits to the end, letters as 10 to 35, 1 modulo 97."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(acc, c):
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(add(acc, c))) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "account":
        return _mod_97(match)
    return match.rlike(STRICT[kind]) if kind in STRICT else F.lit(True)


_FOUND = "array<struct<start:int,end:int,match:string,before:string>>"


def _place(pairs: Column) -> Column:
    """Structs (match, gap before it) with their places. Runs of _RUN are placed one by one, each from the place where it begins, so
    that the work isn't square in the number of matches."""
    n_runs = F.ceil(F.size(pairs) / _RUN).cast("int")

    def placed(runs):
        ends = F.aggregate(
            runs,
            F.array(F.lit(0)),
            lambda acc, run: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(run, F.lit(0), lambda n, p: n + F.length(p["gap"]) + F.length(p["match"])))),
        )

        def step(acc, p):
            s = acc["at"] + F.length(p["gap"])
            e = s + F.length(p["match"])
            span = F.struct(s.alias("start"), e.alias("end"), p["match"].alias("match"), F.substring(p["gap"], -BEFORE, BEFORE).alias("before"))
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        nil = F.array().cast(_FOUND)
        return F.flatten(F.zip_with(runs, F.slice(ends, F.lit(1), F.size(runs)), lambda run, at: F.aggregate(run, F.struct(at.alias("at"), nil.alias("out")), step)["out"]))

    return bound(F.transform(F.sequence(F.lit(0), n_runs - 1), lambda i: F.slice(pairs, i * _RUN + 1, F.lit(_RUN))), placed)


def _found(text: Column, pattern: str, guard) -> Column:
    """Structs (start, end, match, text before it) for the pattern's matches, in order. Places are of code points."""

    def pairs(m):
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
        return bound(F.zip_with(m, gaps, lambda x, g: F.struct(x.alias("match"), g.alias("gap"))), _place)

    found = bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, pairs(m)))
    sign = guard(text) if callable(guard) else text.contains(guard) if guard == "@" else text.rlike(guard)
    return F.coalesce(F.when(sign, found), F.array().cast(_FOUND))


def _voted(kind: str, x: Column) -> Column:
    """The bits of FEATURES for a match of a kind."""
    words = r"(?i)(?<!\p{L})(?:" + "|".join(GAZETTEER[kind]) + r")(?!\p{L})"
    tests = (
        _valid(kind, x["match"]),
        x["before"].rlike(words),
        x["before"].rlike(CONTEXT),
        x["before"].rlike(r"[\"'(<]$"),
        F.length(x["match"]) >= 16,
        F.length(F.regexp_replace(x["match"], "[^0-9]", "")) >= 9,
    )
    return sum((F.when(t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tests)), F.lit(0))


def _meets(m: Column) -> Column:
    """Whether a match overlaps a base span."""
    return F.exists("_base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))


def extract(docs: DataFrame) -> DataFrame:
    """docs with _base (spans: start, k, end, in order) and _more (matches that were voted on: start, end, code: the place in CODES,
    bits). Of matches of base patterns, _more has those with code < len(BASE): they teach, and are no candidates. A candidate that
    overlaps a base span is left out: the base match has said what is there, and the candidate would vote against it. Columns of docs
    with these names are replaced."""
    text = whole("text")
    docs = docs.drop("_base", "_more", "_spans")

    def all_of(code, kind):
        pattern, guard = (PATTERNS[kind], GUARDS[kind]) if kind in PATTERNS else CANDIDATES[kind][1:]
        voted = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(code).alias("code"), _voted(kind, x).alias("bits"))
        return F.transform(_found(text, pattern, guard), voted)

    more = F.concat(*[all_of(code, kind) for code, kind in enumerate(CODES)])
    base = F.transform(F.filter("_more", lambda m: (m["code"] < len(BASE)) & (m["bits"].bitwiseAND(F.lit(1)) == 1)), lambda m: F.struct(m["start"].alias("start"), m["code"].alias("k"), m["end"].alias("end")))
    known = lambda m: (m["code"] < len(BASE)) | ~_meets(m)
    return docs.withColumn("_more", more).withColumn("_base", F.array_sort(base)).withColumn("_more", F.filter("_more", known))


def expectation_maximisation(counts: dict[tuple[int, int], int], rounds: int = 50) -> dict[tuple[int, int], float]:
    """The probability of each (code, bits) to be personal data, from the first VOTERS bits: two classes and independent labelers,
    which are as reliable for every kind; each kind has its own share of true matches. Whether a match of a base pattern is true is no
    guess: it is known from its check, and stays as it is."""
    codes = {c for c, _ in counts}
    prior, hit, false = dict.fromkeys(codes, 0.5), [0.8] * VOTERS, [0.2] * VOTERS
    post: dict[tuple[int, int], float] = {}
    for _ in range(rounds):
        for c, b in counts:
            yes, no = prior[c], 1 - prior[c]
            for i in range(VOTERS):
                yes *= hit[i] if b >> i & 1 else 1 - hit[i]
                no *= false[i] if b >> i & 1 else 1 - false[i]
            post[c, b] = float(b & 1) if c < len(BASE) else yes / (yes + no)
        ones, all_ = sum(post[x] * n for x, n in counts.items()), sum(counts.values())
        for c in codes:
            mine = {x: n for x, n in counts.items() if x[0] == c}
            prior[c] = (sum(post[x] * n for x, n in mine.items()) + 1) / (sum(mine.values()) + 2)
        hit = [(sum(post[x] * n for x, n in counts.items() if x[1] >> i & 1) + 2) / (ones + 2.5) for i in range(VOTERS)]
        false = [(sum((1 - post[x]) * n for x, n in counts.items() if x[1] >> i & 1) + 0.5) / (all_ - ones + 2.5) for i in range(VOTERS)]
    return post


def train(counts: dict[tuple[int, int], int]) -> dict[tuple[int, int], float]:
    """The final classifier, naive Bayes over the kind and all FEATURES, as the probability of each (code, bits) that occurs."""
    post, all_ = expectation_maximisation(counts), sum(counts.values())
    ones = sum(post[x] * n for x, n in counts.items())
    out = {}
    for c, b in counts:
        alike = [[x for x in counts if x[0] == c], *[[x for x in counts if x[1] >> i & 1 == b >> i & 1] for i in range(len(FEATURES))]]
        odds = math.log((ones + 1) / (all_ - ones + 1))
        for same in alike:
            odds += math.log((sum(post[x] * counts[x] for x in same) + 1) / (ones + 2))
            odds -= math.log((sum((1 - post[x]) * counts[x] for x in same) + 1) / (all_ - ones + 2))
        out[c, b] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return out


def with_spans(extracted: DataFrame) -> DataFrame:
    """The result of extract() with _spans: its base spans and the candidates that the trained classifier takes."""
    counted = extracted.select(F.explode("_more").alias("m")).groupBy("m.code", "m.bits").count()
    counts = {(r.code, r.bits): r["count"] for r in counted.collect()}  # at most len(CODES) * 2 ** len(FEATURES) rows
    good = sorted(c << len(FEATURES) | b for (c, b), p in train(counts).items() if p > 0.5 and c >= len(BASE)) if counts else []
    kind_of = F.array(*[F.lit(KINDS.index(CANDIDATES[k][0] if k in CANDIDATES else k)) for k in CODES])
    is_good = lambda m: (m["code"] * (1 << len(FEATURES)) + m["bits"]).isin(good) if good else F.lit(False)
    taken = F.filter("_more", is_good)
    longest = F.array_sort(F.transform(taken, lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("back"), F.get(kind_of, m["code"]).alias("k"))))
    nil = F.array().cast("array<struct<start:int,k:int,end:int>>")

    def step(acc, m):
        span = F.struct(m["start"].alias("start"), m["k"].alias("k"), (-m["back"]).alias("end"))
        clear = F.coalesce(m["start"] >= F.element_at(acc, -1)["end"], F.lit(True))
        return F.when((F.size(acc) > 0) & ~clear, acc).otherwise(F.concat(acc, F.array(span)))

    added = F.when(F.size(taken) > 0, F.aggregate(longest, nil, lambda acc, m: F.when(F.size(acc) == 0, F.array(F.struct(m["start"].alias("start"), m["k"].alias("k"), (-m["back"]).alias("end")))).otherwise(step(acc, m)))).otherwise(nil)
    return extracted.withColumn("_spans", F.array_sort(F.concat("_base", added))).drop("_more")


def find(docs: DataFrame) -> DataFrame:
    """docs with _base and _spans: arrays of (start, k, end), k the place in KINDS.

    Null and empty texts have none; repeated rows have the same; an empty table gives an empty result. Columns of docs with the names
    _base, _more and _spans are replaced; all others are kept.
    """
    return with_spans(materialise(extract(docs), "pii-spans"))


def listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame) -> DataFrame:
    """docs with every span of its text replaced by its kind in square brackets, and n_chars, if there is one, of the new text. Of
    overlapping spans the first is replaced, with the others up to their ends. A null text stays null, an empty one empty; repeated rows are
    masked alike; all other columns are kept, whatever their names; an empty table gives an empty result."""
    rest = [c for c in docs.columns if c != "text"]  # apart, so that no name clashes
    got = find(docs.select(F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)]).alias("_doc"), "text"))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def step(acc, s):
        piece = F.concat(F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["k"]))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)
    text = F.when(F.size("_spans") == 0, F.col("text")).otherwise(bound(done, lambda d: F.concat(F.array_join(d["out"], ""), F.substring("text", d["at"] + 1, F.length("text")))))
    got = got.withColumn("text", text)
    columns = {c: F.col(f"_doc.c{i}") for i, c in enumerate(rest)} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return got.select(*[columns[c].alias(c) for c in docs.columns])


def op5_pii(spark, sf_dir: str) -> DataFrame:
    slim = materialise(extract(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "pii-spans")
    got = with_spans(slim)
    n = lambda k: F.size(F.filter("_base", lambda s: s["k"] == k)).cast("long")
    counts = [n(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return got.select("doc_id", *counts, F.sha2(listed("_base"), 256).alias("base_sha256"), listed("_spans").alias("spans"), F.size("_spans").cast("long").alias("n_spans"))
