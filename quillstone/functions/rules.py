"""Routing and safety rules over a query's text, as columns: the first rule that fits decides."""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wordlists as W
from .text import FILLED, bound, collapsed, has_any, n_words, strip


def _low(query: Column) -> Column:
    return F.lower(F.coalesce(query, F.lit("")))


def length_problem(query: Column, most: int = 100) -> Column:
    """empty or too long (more than most words); null if neither."""
    return F.when(strip(F.coalesce(query, F.lit(""))) == "", "empty").when(n_words(query) > most, "too long")


def quick_intent(query: Column) -> Column:
    """GREETING, FAREWELL or THANKS if the query, without punctuation, is one of the phrases as a whole."""
    q = strip(F.regexp_replace(strip(_low(query)), r"(?U)[^\w\s]", ""))
    return F.when(q.isin(*W.GREETINGS), "GREETING").when(q.isin(*W.FAREWELLS), "FAREWELL").when(q.isin(*W.THANKS), "THANKS")


def needs_empathy(query: Column, phrases=W.EMPATHY) -> Column:
    return has_any(_low(query), phrases)


def needs_disclaimer(query: Column, phrases=W.DECISION) -> Column:
    return has_any(_low(query), phrases)


def is_bereavement(query: Column, phrases=W.BEREAVEMENT) -> Column:
    return has_any(_low(query), phrases)


def is_recommendation(query: Column, phrases=W.for_brand(W.RECOMMENDATION)) -> Column:
    return has_any(_low(query), phrases)


def is_account_lookup(query: Column, phrases=W.ACCOUNT_LOOKUP) -> Column:
    return has_any(_low(query), phrases)


def query_type(query: Column, broad=W.for_brand(W.BROAD), personal=W.PERSONAL) -> Column:
    """SPECIFIC for what is personal, else BROAD with a broad phrase, else SPECIFIC."""
    q = strip(_low(query))
    return F.when(has_any(q, personal), "SPECIFIC").when(has_any(q, broad), "BROAD").otherwise("SPECIFIC")


def follow_up(query: Column, n_history: Column) -> Column:
    """Why a query refers to the conversation before it; null if it doesn't, or if there is none."""
    q = strip(_low(query))
    kinds = (
        (W.HISTORY_REFERENCE, "history_reference"),
        (W.DISAGREEMENT, "disagreement"),
        (W.CLARIFICATION, "clarification"),
        (W.FRUSTRATED_FAREWELL, "frustrated_farewell"),
        (W.CONTINUATION, "continuation"),
    )
    out = F.when((n_words(q) <= 6) & has_any(q, W.IMPLICIT), "implicit_short_query")
    for phrases, kind in reversed(kinds):
        out = F.when(has_any(q, phrases), kind).otherwise(out)
    return F.when(n_history > 0, out)


def is_simple(query: Column, sensitive: Column, kind: Column, technical=W.TECHNICAL) -> Column:
    """Whether the smaller model answers: not what is sensitive, technical or complex; else what is broad; else with two signs of
    simplicity of three."""
    q = _low(query)
    marks = F.regexp_count(q, F.lit(r"\?"))
    complex_ = has_any(q, ("compare", "difference between", "versus", " vs ", "calculate")) | (n_words(q) > 20) | (marks > 1)
    signs = (n_words(q) < 10).cast("int") + (marks == 1).cast("int") + has_any(q, W.SIMPLE).cast("int")
    return F.when(sensitive | has_any(q, technical) | complex_, F.lit(False)).when(kind == "BROAD", F.lit(True)).otherwise(signs >= 2)


def expanded(query: Column, last_user: Column) -> Column:
    """A short query with a word that points back, with the last thing the user said in brackets."""
    words = F.split(collapsed(_low(query)), " ")
    points = F.arrays_overlap(words, F.array(*[F.lit(w) for w in W.AMBIGUOUS]))
    context = F.concat(query, F.lit(" (in context of: "), F.substring(last_user, 1, 60), F.lit(")"))
    return F.when(points & (F.coalesce(last_user, F.lit("")) != "") & (n_words(query) < 8), context).otherwise(query)


def _swapped(phrase: str, term: str):
    return lambda x: F.when(x.contains(term), x).otherwise(F.replace(x, F.lit(phrase), F.lit(term)))


def with_synonyms(text: Column, phrases=W.SYNONYMS, words=W.WORD_SYNONYMS) -> Column:
    """Lower case, phrases and then words in standard terms; a phrase whose term is there already stays; a word that then follows
    itself is one."""
    out = _low(text)
    for phrase, term in phrases:
        if phrase != term:
            out = bound(out, _swapped(phrase, term))
    for word, term in words:
        out = F.regexp_replace(out, rf"(?U)\b{word}\b", term)
    return F.regexp_replace(out, r"(?U)\b(\w+)\s+\1\b", "$1")


#: Words that carry no meaning of their own; not, no, question words and words of order stay.
STOP = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
    their theirs themselves this that these those am is are was were be been being have has had having do does did doing a an the and but
    if or because as until while of at by for with about into above below to from up down in out on off over under again further then
    once here there all any both each few more most other some such only own same so than too very s t can will just don should now""".split()
)


def lemma(word: Column) -> Column:
    """The singular of a plural noun, by the endings of English: an approximation of a dictionary's. vs stays."""
    cut = lambda n, end="": F.concat(F.substring(word, F.lit(1), F.length(word) - n), F.lit(end))
    stays = (F.length(word) < 4) | word.rlike("(ss|us|is|ous)$")
    es = word.rlike("(ses|xes|zes|ches|shes)$")
    return F.when(stays, word).when(word.endswith("ies"), cut(3, "y")).when(es, cut(2)).when(word.endswith("s"), cut(1)).otherwise(word)


def normal_query(text: Column, stop=STOP) -> Column:
    """The form by which answers are looked up: synonyms, no punctuation, no stop words, singular."""
    bare = F.regexp_replace(with_synonyms(strip(_low(text))), r"(?U)[^\w\s]", "")
    words = F.filter(F.split(collapsed(bare), " "), lambda w: (w != "") & ~w.isin(*stop))
    return F.array_join(F.transform(words, lemma), " ")


@cache
def signs(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which every match of pattern, in any case, contains one; none if no such set can be read off. Of the sets that the parts of
    a sequence give, the one whose shortest literal is longest."""

    def of(parts) -> tuple[str, ...]:
        sets, run = [], ""
        for kind, value in [*parts, (None, None)]:
            if kind == sre.LITERAL:
                run += chr(value)
                continue
            if kind == sre.AT:  # takes no room, so letters on both sides stand together
                continue
            if run:
                sets.append((run.lower(),))
                run = ""
            if kind == sre.SUBPATTERN:
                sets.append(of(value[3]))
            elif kind == sre.BRANCH:
                each = [of(x) for x in value[1]]
                sets.append(tuple(dict.fromkeys(y for x in each for y in x)) if all(each) else ())
            elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0]:
                sets.append(of(value[2]))
        return max(filter(None, sets), key=lambda x: (min(map(len, x)), -len(x)), default=())

    return of(sre_parser.parse(pattern))


def _any_of(low: Column, patterns) -> Column:
    """Whether any of patterns occurs in low, a text in lower case. A literal is found much faster than a pattern: a pattern is tried only where one of its
    signs stands."""

    def tried(t):
        out = F.lit(False)
        for p in patterns:
            hit, found = t.rlike(f"(?i){p}"), signs(p)
            out = out | (reduce(or_, [t.contains(x) for x in found]) & hit if found else hit)
        return out

    return bound(low, tried)


def personal_data(text: Column, kinds=W.PERSONAL_DATA) -> Column:
    """The kinds of personal data that text has, in their order. Each needs a digit or an @."""
    all_kinds = lambda t: F.array_compact(F.array(*[F.when(t.rlike(f"(?i){p}"), F.lit(k)) for k, p, _ in kinds]))
    return bound(F.coalesce(text, F.lit("")), lambda t: F.when(has_any(t, tuple("0123456789@")), all_kinds(t)).otherwise(F.array().cast("array<string>")))


def masked(text: Column, kinds=W.PERSONAL_DATA) -> Column:
    """text with personal data replaced, kind after kind."""
    out = F.coalesce(text, F.lit(""))
    for _, pattern, shown in kinds:
        out = F.regexp_replace(out, f"(?i){pattern}", shown.replace("$", r"\$"))
    return out


def blocks_personal(text: Column, named: Column | None = None, blocking=W.BLOCKING) -> Column:
    """Whether text has personal data that stops a query; named: whether a recogniser of names has found one, null if none ran."""
    found = F.size(personal_data(text, tuple(k for k in W.PERSONAL_DATA if k[0] in blocking))) > 0
    return found if named is None else found | F.coalesce(named, F.lit(False))


def is_allowed_name(span: Column, names: list[str], least: float = 0.85) -> Column:
    """Whether a name that was found is, nearly, one of those that are allowed."""
    from .text import partial_similarity

    out = F.lit(False)
    for n in names:
        out = out | (partial_similarity(span, F.lit(n)) >= least)
    return out


def _is_irrelevant(low: Column, words=W.IRRELEVANT, patterns=W.IRRELEVANT_PATTERNS, relevant=W.for_brand(W.RELEVANT)) -> Column:
    return (has_any(low, words) | _any_of(low, patterns)) & ~has_any(low, relevant)


def is_irrelevant(text: Column, words=W.IRRELEVANT, patterns=W.IRRELEVANT_PATTERNS, relevant=W.for_brand(W.RELEVANT)) -> Column:
    return bound(_low(text), lambda low: _is_irrelevant(low, words, patterns, relevant))


def is_crime(text: Column) -> Column:
    return _any_of(_low(text), W.CRIME)


def is_weapons(text: Column) -> Column:
    return _any_of(_low(text), W.WEAPONS)


def is_injection(text: Column) -> Column:
    return _any_of(_low(text), W.INJECTION)


def is_jailbreak(text: Column) -> Column:
    return _any_of(_low(text), W.JAILBREAK)


def is_severe(severities: list[Column], least: int = 2) -> Column:
    """Whether a moderation service rates any category at least that; null ratings count as none."""
    return F.greatest(*[F.coalesce(s, F.lit(0)) for s in severities], F.lit(0)) >= least if severities else F.lit(False)


def input_problem(text: Column, named: Column | None = None, shield: Column | None = None, severities: list[Column] | None = None) -> Column:
    """Why a query is refused, by the first check that fails: pii, irrelevant or harmful; null if it is safe.

    shield: the verdict of a classifier of attacks, true for clean, false for an attack, null if it wasn't reached: only then do the
    patterns of injection and jailbreak decide. A service that fails leaves the query alone."""
    shield = F.lit(None).cast("boolean") if shield is None else shield

    def first(raw, low):
        out = F.when(~raw.rlike(FILLED), "irrelevant").when(blocks_personal(raw, named), "pii").when(_is_irrelevant(low), "irrelevant")
        out = out.when(_any_of(low, W.CRIME + W.WEAPONS), "harmful").when(shield == F.lit(False), "harmful")
        out = out.when(shield.isNull() & _any_of(low, W.INJECTION + W.JAILBREAK), "harmful")
        return out.when(is_severe(severities or []), "harmful")

    return bound(F.coalesce(text, F.lit("")), lambda raw: bound(F.lower(raw), lambda low: first(raw, low)))


def refusal(reason: Column, templates: dict[str, str], default: str = "general") -> Column:
    """The text of a refusal; that of the default for a reason without one, null for none."""
    known = F.create_map(*[F.lit(x) for pair in templates.items() for x in pair])
    return F.when(reason.isNotNull(), F.coalesce(F.try_element_at(known, reason), F.lit(templates.get(default))))
