"""Keeping an index of chunks in step with its pages: plans, gates, snapshots, changes and promotion.

An index is a table of chunks (chunk_id, source_url, dropdown_url, ...). Plans are read-only tables; applying one writes a new version of a
sources.snapshots.Table and moves its pointer, so that a failure leaves the old one in place. Gates are one row of counts, checked before
anything is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..sources.snapshots import Pointer, Table


class Refused(RuntimeError):
    """A gate has stopped a run before it wrote anything."""


def _identity() -> Column:
    return U.identity(F.col("source_url"), F.col("dropdown_url"))


def first_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key, by aggregation: a key of many rows is combined before it is shuffled. Null keys are one key."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, "_b.*").select(*df.columns)


def duplicates_of(df: DataFrame, key: Column, value: str, order: str) -> DataFrame:
    """df with is_duplicate and duplicate_of: value of the first row of the same key, "" for that row itself."""
    firsts = df.groupBy(key.alias("_g")).agg(F.min_by(F.struct(F.col(value).alias("v"), F.col(order).alias("o")), order).alias("_f"))
    out = df.withColumn("_k", key).join(firsts, F.col("_k").eqNullSafe(F.col("_g"))).drop("_g")
    other = F.col("_f.o") != F.col(order)
    return out.withColumn("is_duplicate", other).withColumn("duplicate_of", F.when(other, F.col("_f.v").cast("string")).otherwise("")).drop("_k", "_f")


def stale_plan(stored: DataFrame, fresh: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """chunk_id, identity and action of each chunk stored (chunk_id, source_url, dropdown_url): keep if fresh chunks have its id, retain if its
    page, by identity or source_url, is protected (url), else stale; gone: whether no fresh chunk has its identity."""
    new_ids, new_idents = fresh.select("chunk_id").distinct(), fresh.select(_identity().alias("identity")).distinct()
    rows = stored.select("chunk_id", _identity().alias("identity"), F.regexp_replace(F.coalesce("source_url", F.lit("")), "/+$", "").alias("_base"))
    rows = rows.join(new_ids.withColumn("_kept", F.lit(True)), "chunk_id", "left").join(new_idents.withColumn("_here", F.lit(True)), "identity", "left")
    safe = F.lit(None).cast("boolean")
    if protected is not None:
        urls = protected.select(F.regexp_replace("url", "/+$", "").alias("_u")).distinct()
        rows = rows.join(urls.select(F.col("_u").alias("identity"), F.lit(True).alias("_p1")), "identity", "left")
        rows = rows.join(urls.select(F.col("_u").alias("_base"), F.lit(True).alias("_p2")), "_base", "left")
        safe = F.coalesce("_p1", "_p2")
    action = F.when(F.col("_kept"), "keep").when(safe, "retain").otherwise("stale")
    return rows.select("chunk_id", "identity", action.alias("action"), F.col("_here").isNull().alias("gone"))


def stale_gate(plan: DataFrame, at_least: int = 3, share: float = 0.1) -> DataFrame:
    """One row of stale_plan()'s result: n_stale, n_retained, n_gone and n_identities, and aborted: at_least identities or more are gone, and
    more than share of all."""
    one = plan.groupBy("identity").agg(F.count_if(F.col("action") == "stale").alias("stale"), F.count_if(F.col("action") == "retain").alias("retained"), F.bool_or((F.col("action") == "stale") & F.col("gone")).alias("gone"))
    out = one.agg(F.coalesce(F.sum("stale"), F.lit(0)).alias("n_stale"), F.coalesce(F.sum("retained"), F.lit(0)).alias("n_retained"), F.count_if("gone").alias("n_gone"), F.count("*").alias("n_identities"))
    return out.withColumn("aborted", (F.col("n_gone") >= at_least) & (F.col("n_gone") > share * F.col("n_identities")))


def three_way(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """key and change (added, updated or deleted) between the keys that are there and those that are wanted."""
    e, w = existing.select(key).distinct().withColumn("_e", F.lit(1)), wanted.select(key).distinct().withColumn("_w", F.lit(1))
    change = F.when(F.col("_e").isNull(), "added").when(F.col("_w").isNull(), "deleted").otherwise("updated")
    return e.join(w, key, "full_outer").select(key, change.alias("change"))


def removal_gate(plan: DataFrame, at_least: int = 3, share: float = 0.5) -> DataFrame:
    """One row of three_way()'s result: added, updated, deleted and refused: at_least deletions or more, and more than share of what is there."""
    n = lambda c: F.count_if(F.col("change") == c).alias(c)
    out = plan.agg(n("added"), n("updated"), n("deleted"))
    there = F.col("updated") + F.col("deleted")
    return out.withColumn("refused", (F.col("deleted") >= at_least) & (F.col("deleted") > share * there))


def current_state(chunks: DataFrame, order: str = "chunk_id") -> DataFrame:
    """identity (lower case), content_hash, video_url, is_variant and source_url of the first chunk of each identity."""
    variant = U.blank_to_null(F.col("dropdown_url"))
    rows = chunks.select(U.lowered_url(F.coalesce(variant, F.col("source_url"))).alias("identity"), "content_hash", "video_url", variant.isNotNull().alias("is_variant"), "source_url", F.col(order).alias("_o"))
    return first_by(rows.filter("identity <> ''"), ["identity"], "_o").drop("_o")


def refresh_counts(chunks: DataFrame) -> DataFrame:
    """identity and the highest refresh_count of its chunks, null as 0."""
    ident = U.lowered_url(F.coalesce(U.blank_to_null(F.col("dropdown_url")), F.col("source_url")))
    return chunks.groupBy(ident.alias("identity")).agg(F.max(F.coalesce("refresh_count", F.lit(0))).alias("refresh_count"))


def chunks_of(chunks: DataFrame, urls: DataFrame) -> DataFrame:
    """The chunks of pages (url): all whose source_url is that page, in lower case, whatever their variant."""
    wanted = urls.select(U.lowered_url(F.col("url")).alias("_u")).distinct()
    return chunks.join(wanted, U.lowered_url(F.col("source_url")) == F.col("_u"), "left_semi")


def deletion_counts(chunks: DataFrame, urls: DataFrame) -> DataFrame:
    """url and n_chunks that its deletion takes; urls without any are left out."""
    wanted = urls.select("url", U.lowered_url(F.col("url")).alias("_u")).distinct()
    there = chunks.groupBy(U.lowered_url(F.col("source_url")).alias("_u")).agg(F.count("*").alias("n_chunks"))
    return wanted.join(there, "_u").select("url", "n_chunks")


def with_variants(chunks: DataFrame, urls: DataFrame) -> DataFrame:
    """url: those of urls, and of the variants of their pages that are stored as source_url."""
    base = urls.select(U.lowered_url(F.col("url")).alias("_u")).distinct()
    found = chunks.select(F.col("source_url").alias("url")).filter(U.is_variant(F.col("url"))).distinct()
    found = found.join(base, U.lowered_url(U.base_url(F.col("url"))) == F.col("_u"), "left_semi")
    return urls.select("url").unionByName(found).distinct()


def invalidated(cache: DataFrame, urls: DataFrame, key: str = "query") -> DataFrame:
    """key of the cached answers whose source_urls hold one of urls. Sources become rows and meet by a join; nothing is compared in pairs."""
    changed = urls.select(U.lowered_url(F.col("url")).alias("_u")).distinct()
    rows = cache.select(key, F.explode("source_urls").alias("_s")).withColumn("_u", U.lowered_url(F.col("_s")))
    return rows.join(changed, "_u", "left_semi").select(key).distinct()


def matched_pages(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """urls (url) with the columns of the page (url) that is the same but for trailing slashes; without one they are null."""
    cut = lambda c: F.regexp_replace(c, "/+$", "")
    there = pages.withColumn("_u", cut("url")).withColumnRenamed("url", "page_url")
    return urls.withColumn("_u", cut("url")).join(there, "_u", "left").drop("_u")


def new_only(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pages whose source_url no chunk has."""
    return pages.join(chunks.select("source_url").filter("source_url <> ''").distinct(), "source_url", "left_anti")


def freshness(approved: DataFrame, health: DataFrame, state: DataFrame, scraped: DataFrame) -> DataFrame:
    """url and action for every approved page (url), and every stored page that is approved no more.

    health: (url, status); state: current_state(); scraped: (source_url, dropdown_url, content_hash, video_url) of what was fetched anew.
    A page that is dead, or leads elsewhere, is removed; one that can't be reached, or gave nothing, is scrape_failed; one that isn't stored
    is new; else it is changed if any of its identities is new, or has another hash or video, and unchanged if none has."""
    pages = approved.select("url", U.lowered_url(F.col("url")).alias("_u"), U.lowered_url(U.base_url(F.col("url"))).alias("_base"))
    status = health.select(U.lowered_url(F.col("url")).alias("_u"), "status")
    got = scraped.select(U.lowered_url(F.col("source_url")).alias("_base"), U.lowered_url(F.coalesce(U.blank_to_null(F.col("dropdown_url")), F.col("source_url"))).alias("identity"), F.col("content_hash").alias("_h"), F.coalesce("video_url", F.lit("")).alias("_v"))
    seen = got.join(state.select("identity", "content_hash", F.coalesce("video_url", F.lit("")).alias("video_url")), "identity", "left")
    other = F.col("content_hash").isNull() | (F.col("content_hash") != F.col("_h")) | (F.col("video_url") != F.col("_v"))
    per_page = seen.groupBy("_base").agg(F.bool_or(other).alias("_changed"), F.bool_or(F.col("video_url") != F.col("_v")).alias("video_changed"))
    stored = state.filter("NOT is_variant").select(F.col("identity").alias("_base"), F.lit(True).alias("_stored")).distinct()
    out = pages.join(status, "_u", "left").join(per_page, "_base", "left").join(stored, "_base", "left")
    s = F.col("status")
    action = F.when(s == "dead_404", "removed_404").when(s == "dead_5xx", "removed_5xx").when(s == "internal_redirect", "removed_int_redir")
    action = action.when(s == "external_redirect", "removed_ext_redir").when(s.isin("timeout", "error"), "scrape_failed")
    action = action.when(F.col("_changed").isNull(), "scrape_failed").when(F.col("_stored").isNull(), "new").when(F.col("_changed"), "changed").otherwise("unchanged")
    rows = out.select("url", action.alias("action"), F.coalesce("video_changed", F.lit(False)).alias("video_changed"))
    listed = approved.select(U.lowered_url(F.col("url")).alias("identity")).distinct()
    gone = state.filter("NOT is_variant").join(listed, "identity", "left_anti").select(F.col("identity").alias("url"), F.lit("removed_delisted").alias("action"), F.lit(False).alias("video_changed"))
    return rows.unionByName(gone)


def freshness_breaker(actions: DataFrame, state: DataFrame, at_least: int = 3, share: float = 0.1) -> DataFrame:
    """One row: n_removed, n_pages, most and tripped: more are removed than the greater of at_least and whole share of the stored pages (of the
    approved ones if none is stored)."""
    n = actions.agg(F.count_if(F.col("action").startswith("removed_")).alias("n_removed"), F.count_if(F.col("action") != "removed_delisted").alias("_n"))
    out = n.crossJoin(state.filter("NOT is_variant").agg(F.count("*").alias("_s")))  # one row each
    out = out.select("n_removed", F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.col("_n")).alias("n_pages"))
    return out.withColumn("most", F.greatest(F.lit(at_least), F.floor(F.col("n_pages") * share))).withColumn("tripped", F.col("n_removed") > F.col("most"))


#: Phrases that belong to a page's frame, not to its content.
FRAME = ("skip to main content", "accept all cookies", "cookie settings", "back to top", "javascript is disabled", "enable javascript")


def page_problems(new: DataFrame, old: DataFrame, least: int = 100, drop: float = 30.0, frame=FRAME) -> DataFrame:
    """severity, url, variant and problem of the pages of new (url, variant, title, content) against those of the run before.

    short (WARN if it was short before, too), no heading (of base pages, if the title isn't in the text either), frame, shrunk (by more than
    drop percent), identical (one for a text on several urls, at the first of them) and missing. A short page has no other problem."""
    n = new.select("url", F.coalesce("variant", F.lit("")).alias("variant"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("c"), F.lit(True).alias("_n"))
    o = old.select("url", F.coalesce("variant", F.lit("")).alias("variant"), F.coalesce("content", F.lit("")).alias("oc"), F.lit(True).alias("_o"))
    both = n.join(o, ["url", "variant"], "full_outer")
    short = F.length(T.strip(F.col("c"))) < least
    title, low = F.lower(T.strip(F.col("title"))), F.lower("c")
    headless = (F.col("variant") == "") & ~F.col("c").rlike(r"(?m)^#\s+\S") & ~((title != "") & low.contains(title))
    shrunk = F.col("_o").isNotNull() & (F.length("oc") > 0) & ((F.length("oc") - F.length("c")) * 100 / F.when(F.length("oc") > 0, F.length("oc")) > drop)
    was_short = F.col("_o").isNotNull() & (F.length(T.strip(F.col("oc"))) < least)
    one = lambda sev, name: F.struct(F.lit(sev).alias("severity"), F.lit(name).alias("problem"))
    none = F.lit(None).cast("struct<severity:string,problem:string>")
    fine = [F.when(headless, one("ERROR", "no heading")), F.when(T.has_any(low, frame), one("WARN", "frame")), F.when(shrunk, one("ERROR", "shrunk"))]
    found = F.when(F.col("_n").isNull(), F.array(one("WARN", "missing"))).when(short, F.array(F.when(was_short, one("WARN", "short")).otherwise(one("ERROR", "short")), none))
    rows = both.select("url", "variant", F.explode(F.array_compact(found.otherwise(F.array(*fine)))).alias("p")).select("p.severity", "url", "variant", "p.problem")
    same = n.filter(~short).groupBy(T.collapsed(F.col("c")).alias("_t")).agg(F.count_distinct("url").alias("_k"), F.min(F.struct("url", "variant")).alias("_f")).filter("_k > 1")
    return rows.unionByName(same.select(F.lit("WARN").alias("severity"), "_f.url", "_f.variant", F.lit("identical").alias("problem")))


def scrape_problems(docs: DataFrame) -> DataFrame:
    """One row: n_docs, n_repeated (urls that occur more than once), n_orphans (variants, or urls of states, without parent_url) and ok."""
    orphan = (F.coalesce(F.col("parent_url"), F.lit("")) == "") & ((F.coalesce(F.col("dropdown_state"), F.lit("")) != "") | F.col("url").contains("#state="))
    one = docs.withColumn("_o", orphan).groupBy("url").agg(F.count("*").alias("n"), F.count_if("_o").alias("o"))
    out = one.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.coalesce(F.sum("o"), F.lit(0)).alias("n_orphans"))
    return out.withColumn("ok", (F.col("n_docs") > 0) & (F.col("n_repeated") == 0) & (F.col("n_orphans") == 0))


def repetition(rows: DataFrame, digest: Column, most: float = 0.0) -> DataFrame:
    """One row: n_rows, n_groups of equal digests, n_removable, share and ok (share is at most that). Null and empty digests don't repeat."""
    groups = rows.groupBy(F.nullif(digest, F.lit("")).alias("d")).agg(F.count("*").alias("n"))
    many = F.col("d").isNotNull() & (F.col("n") > 1)
    out = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_if(many).alias("n_groups"), F.coalesce(F.sum(F.when(many, F.col("n") - 1)), F.lit(0)).alias("n_removable"))
    share = F.coalesce(F.col("n_removable") / F.when(F.col("n_rows") > 0, F.col("n_rows")), F.lit(0.0))
    return out.withColumn("share", share).withColumn("ok", (F.col("n_rows") > 0) & (F.col("share") <= most))


def survivors(rows: DataFrame, digest: Column, at: str, key: str) -> DataFrame:
    """key, survivor and is_victim of every row of a digest that two rows or more have: the oldest by `at`, null first, then by key, survives."""
    order = F.struct(F.coalesce(F.col(at).cast("string"), F.lit("")).alias("a"), F.col(key).alias("k"))
    keyed = rows.select(F.col(key), digest.alias("_d"), order.alias("_o"))
    firsts = keyed.groupBy("_d").agg(F.count("*").alias("_n"), F.min("_o").alias("_f")).filter("_n > 1")
    out = keyed.join(firsts, "_d")
    return out.select(key, F.col("_f.k").alias("survivor"), (F.col("_o") != F.col("_f")).alias("is_victim"))


def failure_gate(rows: DataFrame, failed: Column, most: float = 0.05) -> DataFrame:
    """One row: n, n_failed, ratio and ok (at most that)."""
    out = rows.agg(F.count("*").alias("n"), F.count_if(failed).alias("n_failed"))
    return out.withColumn("ratio", F.coalesce(F.col("n_failed") / F.when(F.col("n") > 0, F.col("n")), F.lit(0.0))).withColumn("ok", F.col("ratio") <= most)


def promotion(indexes: DataFrame, live: str | None, wanted: str | None = None, force: bool = False, least: int = 20, ratio: float = 0.5, keep: int = 3) -> DataFrame:
    """name and role of each of indexes (name, n_docs): promoted, live, kept or dropped, with a reason on the one that was to be promoted: index not
    found, already live, or shrink gate (it has less than ratio of the live one's documents, which has at least that many). The newest by
    name is promoted unless one is wanted; the last keep by name stay, and so do the promoted and the live one until then."""
    rows = {r.name: r.n_docs for r in indexes.select("name", "n_docs").collect()}  # a handful of indexes
    built = sorted(rows)
    target = wanted or (built[-1] if built else None)
    shrunk = live in rows and not force and rows[live] >= least and rows.get(target, 0) < ratio * rows[live]
    reason = "index not found" if target not in rows else "already live" if target == live else "shrink gate" if shrunk else None
    stays = set(built[-keep:]) | {target, live}

    def role(name):
        if reason is None:
            return "promoted" if name == target else "kept" if name in stays else "dropped"
        return "live" if name == live else "kept"

    out = [(n, rows[n], role(n), reason if n == target else None) for n in built]
    return indexes.sparkSession.createDataFrame(out or [], "name string, n_docs bigint, role string, reason string")


#: Fixed values of the templated answers' sheet.
INTENTS = ("blocked", "direct", "grounded")
SCENARIOS = ("not_applicable", "standard", "advice_seeking", "distress", "escalation_and_handoff", "account_action")


def _links(kind: str, name: str, most: int, hosts: list[str]) -> list[Column]:
    """Problems of the numbered pairs of a link's name and url."""
    out = []
    for i in range(1, 10):
        x, y = F.coalesce(f"{kind}_{i}_{name}", F.lit("")), F.coalesce(f"{kind}_{i}_url", F.lit(""))
        some = (x != "") | (y != "")
        bad = F.when((x == "") | (y == ""), f"{kind} {i}: both {name} and url are required").when(U.link_problem(y, hosts).isNotNull(), F.concat(F.lit(f"{kind} {i} url "), U.link_problem(y, hosts)))
        out.append(F.when(some & F.lit(i > most), f"{kind} {i}: at most {most} allowed").when(some, bad))
    return out


def validate_answers(rows: DataFrame, hosts: list[str], hard: int = 250, soft: int = 180, links: int = 3) -> DataFrame:
    """The active rows of a sheet of answers (_row, id, question, answer, intent, scenario, advice_boundary, active, citation_i_title and _url,
    cta_i_label and _url; missing columns are empty) with entry_id, errors and warnings. A question or an id that an earlier row has is an error."""
    names = ["id", "question", "answer", "intent", "scenario", "advice_boundary", "active"] + [f"{k}_{i}_{x}" for k, n in (("citation", "title"), ("cta", "label")) for i in range(1, 10) for x in (n, "url")]
    full = rows.select("_row", *[F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) if n in rows.columns else F.lit("").alias(n) for n in names])
    full = full.filter(~F.lower("active").isin("n", "no", "false", "0"))
    q, a = F.col("question"), F.col("answer")
    intent, scenario = (F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)) for c, d in (("intent", "grounded"), ("scenario", "standard")))
    entry = F.coalesce(F.nullif(F.col("id"), F.lit("")), F.when(q != "", T.question_id(q)))
    full = full.withColumn("entry_id", entry).withColumn("_q", F.when(q != "", T.same_question(q)))
    first = lambda key: full.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("_row").alias(f"_first{key}"))
    full = full.join(first("_q"), "_q", "left").join(first("entry_id"), "entry_id", "left")
    errors = [
        F.when(q == "", "question is empty"),
        F.when(a == "", "answer is empty").when(F.length(a) > hard, F.concat(F.lit("answer is "), F.length(a).cast("string"), F.lit(f" chars, over the {hard} limit"))),
        F.when(~intent.isin(*INTENTS), "intent is unknown"),
        F.when(~scenario.isin(*SCENARIOS), "scenario is unknown"),
        F.when(T.boolean(F.col("advice_boundary")).isNull(), "advice_boundary must be true/false"),
        *_links("citation", "title", links, hosts),
        *_links("cta", "label", links, hosts),
        F.when((F.col("id") != "") & ~F.col("id").rlike(r"^[A-Za-z0-9\-][A-Za-z0-9_=\-]*$"), "id has invalid characters"),
        F.when(F.col("_first_q") < F.col("_row"), F.concat(F.lit("duplicate of row "), F.col("_first_q").cast("string"))),
        F.when(F.col("_firstentry_id") < F.col("_row"), F.concat(F.lit("id already used in row "), F.col("_firstentry_id").cast("string"))),
    ]
    long = F.when((F.length(a) > soft) & (F.length(a) <= hard), F.array(F.lit("answer is over the soft limit"))).otherwise(F.array().cast("array<string>"))
    return full.withColumn("errors", F.array_compact(F.array(*errors))).withColumn("warnings", long).drop("_q", "_first_q", "_firstentry_id")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The next snapshot of table, with rows in place of those of the same key. Rows must have one of each key."""
    if rows.groupBy(key).count().filter("count > 1").limit(1).count():
        raise Refused(f"several rows have the same {key}")
    return table.join(rows, key, "left_anti").unionByName(rows)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def apply_plan(index: Table, rows: DataFrame, stale: DataFrame, key: str, aborted: bool = False, batch: str | None = None) -> int:
    """Commits the next version of index: rows put in, then stale keys out, counted against what is expected before the pointer moves; returns
    its number. Refuses if a gate aborts, before anything is written. A batch of a name that was committed changes nothing."""
    if aborted:
        raise Refused("too many pages would vanish")
    if batch is not None and (done := index.of_batch(batch)):
        return done
    base = index.version()
    now = index.read(base)
    expected = delete(now.select(key).union(rows.select(key)).distinct(), stale, key)
    return index.write(delete(upsert(now, rows, key), stale, key), base=base, check=lambda df: verify_count(df, expected.count()), batch=batch)


def promote(alias: Pointer, plan: DataFrame, drop: Callable[[str], object] | None = None) -> str:
    """Moves alias to the index that promotion() promotes, then drops those that it drops, and returns the new name. Refuses for the reason that the
    plan gives; Stale if another promotion came first. A drop that fails leaves the alias moved."""
    base = alias.version()
    rows = plan.collect()  # a handful of indexes
    new = next((r.name for r in rows if r.role == "promoted"), None)
    if new is None:
        raise Refused(next((r.reason for r in rows if r.reason), "index not found"))
    alias.move(new, base)
    for r in rows:
        if r.role == "dropped" and drop is not None:
            drop(r.name)
    return new


def verify_count(table: DataFrame, expected: int) -> int:
    got = table.count()
    if got != expected:
        raise RuntimeError(f"{got} rows, expected {expected}")
    return got


def verify_search(found: DataFrame) -> bool:
    """Whether a test query found anything."""
    return found.limit(1).count() > 0
