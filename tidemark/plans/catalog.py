"""Queries that make and match a catalog, over the tables as stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import catalog as C
from tidemark.plans.registry import query
from tidemark.sources.tables import load, utc

# Titles with markers of every kind, by the part's size.
SUFFIXES = (" (2011 Remaster)", " - Live at Home", " (Radio Edit)", " [Extended]", " - Acoustic; Demo", " (Deluxe Edition)", " feat. Someone", "", "", "")
_TITLE = "p_name || list_extract([" + ", ".join(f"'{s}'" for s in SUFFIXES) + "], p_size % 10 + 1)"
_ALBUM = "CASE WHEN p_partkey % 9 = 0 THEN 'Special Edition' ELSE p_brand END"
_SUFFIX_TAGS = "[['remaster'], ['live'], ['radio_edit', 'remix'], ['extended'], ['acoustic', 'demo'], ['version'], [], [], [], []]"


def titles(spark, sf):
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), F.col("p_size") % 10 + 1)
    album = F.when(F.col("p_partkey") % 9 == 0, "Special Edition").otherwise(F.col("p_brand"))
    return load(spark, sf, "part").select("p_partkey", F.concat("p_name", suffix).alias("title"), album.alias("album"))


def catalog_plays(spark, sf):
    """Order lines as plays of titles, a fourth of them without an external id."""
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    suppliers = load(spark, sf, "supplier").select("s_suppkey", "s_name")
    joined = lines.join(titles(spark, sf), F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), utc(F.col("l_shipdate")).alias("ts"), (F.col("l_quantity") * 1000).cast("long").alias("ms_played"), "title",
        F.concat("s_name", F.when(F.col("s_suppkey") % 3 == 0, ", Guest").otherwise("")).alias("artist"), "album",
        F.when(F.col("l_partkey") % 4 != 0, F.concat(F.lit("T"), F.col("l_partkey"), F.lit("-"), F.col("l_suppkey") % 2)).alias("external_id"),
    )


_NORM = lambda c: f"trim(regexp_replace(regexp_replace(lower({c}), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_PARSED = f"""SELECT p_partkey, title, album, tags || CASE WHEN p_partkey % 9 = 0 THEN ['deluxe'] ELSE [] END AS found, base
    FROM (SELECT p_partkey, {_TITLE} AS title, {_ALBUM} AS album, list_extract({_SUFFIX_TAGS}, p_size % 10 + 1) AS tags, p_name AS base FROM part)"""
_KIND = "coalesce(list_extract(list_filter(found, lambda t: t NOT IN ('version', 'deluxe')), 1), CASE WHEN list_contains(found, 'deluxe') THEN 'deluxe' END, 'original')"


@query(f"""SELECT p_partkey, title, base AS base_title, {_KIND} AS variant_type, list_sort(list_distinct(found)) AS variant_tags, {_NORM('base')} AS norm_title FROM ({_PARSED})""")
def parse_titles(spark, sf):
    rows = titles(spark, sf).withColumn("p", X.parse_title(F.col("title"), F.col("album")))
    return rows.select("p_partkey", "title", "p.base_title", "p.variant_type", "p.variant_tags", X.normalize(F.col("p.base_title")).alias("norm_title"))


@query(r"""SELECT doc_id, md5(n) AS digest, length(n) AS n_chars FROM (SELECT doc_id,
    trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS n FROM documents)""")
def normalize_text(spark, sf):
    n = X.normalize(F.col("text"), native=True)
    return load(spark, sf, "documents").select("doc_id", F.md5(n.cast("binary")).alias("digest"), F.length(n).cast("long").alias("n_chars"))


_PLAYS = f"""WITH parsed AS ({_PARSED}), plays AS (
    SELECT l_orderkey * 10 + l_linenumber AS seq, l_shipdate AS ts, CAST(l_quantity * 1000 AS BIGINT) AS ms, title,
        s_name || CASE WHEN s_suppkey % 3 = 0 THEN ', Guest' ELSE '' END AS artist, album,
        CASE WHEN l_partkey % 4 <> 0 THEN 'T' || l_partkey || '-' || (l_suppkey % 2) END AS external_id,
        {_NORM('s_name')} || '|' || {_NORM('base')} AS norm_key, list_sort(list_distinct(found)) AS tags, {_KIND} AS variant_type
    FROM lineitem JOIN parsed ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
), keyed AS (SELECT *, norm_key || '#' || array_to_string(tags, ',') AS vkey FROM plays
), owned AS (SELECT *, CASE WHEN external_id IS NULL THEN vkey ELSE first_value(vkey) OVER (PARTITION BY external_id ORDER BY seq) END AS entry_key FROM keyed
), entries AS (SELECT entry_key, sha256(entry_key) AS entry_id, arg_min(external_id, seq) FILTER (external_id IS NOT NULL) AS external_id, arg_min(title, seq) AS title,
    arg_min(artist, seq) AS artist, arg_min(album, seq) AS album, arg_min(norm_key, seq) AS norm_key, arg_min(variant_type, seq) AS variant_type,
    arg_min(tags, seq) AS variant_tags, count(*) AS play_count, sum(ms)::BIGINT AS total_ms_played, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, min(seq) AS first_seq
    FROM owned GROUP BY entry_key)
"""


def _catalog(spark, sf):
    return C.build_catalog(C.assign_entries(C.with_identity(catalog_plays(spark, sf))))


@query(_PLAYS + "SELECT seq, sha256(entry_key) AS entry_id, entry_key FROM owned")
def play_assignments(spark, sf):
    return C.assign_entries(C.with_identity(catalog_plays(spark, sf))).select("seq", "entry_id", "entry_key")


@query(_PLAYS + "SELECT * FROM entries")
def catalog_entries(spark, sf):
    out = _catalog(spark, sf).withColumn("first_us", F.unix_micros("first_played_at")).withColumn("last_us", F.unix_micros("last_played_at"))
    return out.drop("first_played_at", "last_played_at")


_REL = "CASE list_extract(list_filter(variant_tags, lambda t: t NOT IN ('version', 'deluxe')), 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.RELATIONS.items()) + " ELSE 'duplicate' END"
_LINKS = f"""SELECT entry_id AS track_a, canonical AS track_b, 'name' AS method, {_REL} AS relation, 0.9::DOUBLE AS score FROM (
    SELECT *, row_number() OVER w AS place, first_value(entry_id) OVER w AS canonical FROM entries
    WINDOW w AS (PARTITION BY norm_key ORDER BY variant_type = 'original' DESC, play_count DESC, first_seq)) WHERE place > 1"""


@query(_PLAYS + _LINKS)
def variant_links(spark, sf):
    return C.variant_links(_catalog(spark, sf))


@query(_PLAYS + f"SELECT (SELECT count(*) FROM entries) AS entries, count(*) AS variants, count(DISTINCT track_b) AS groups FROM ({_LINKS})")
def catalog_summary(spark, sf):
    entries = _catalog(spark, sf)
    links = C.variant_links(entries).agg(F.count("*").alias("variants"), F.countDistinct("track_b").alias("groups"))
    return entries.agg(F.count("*").alias("entries")).crossJoin(links)


_CUST = "SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment || '-' || c_nationkey END AS isrc, CAST(floor(c_acctbal / 1000) AS BIGINT) AS play_count FROM customer"


def _tracks(spark, sf):
    isrc = F.when(F.col("c_custkey") % 7 != 0, F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey")))
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), isrc.alias("isrc"), F.floor(F.col("c_acctbal") / 1000).alias("play_count"))


@query(f"""WITH c AS ({_CUST}), r AS (SELECT *, first_value(id) OVER w AS best, count(*) OVER (PARTITION BY isrc) AS n FROM c WHERE isrc IS NOT NULL
    WINDOW w AS (PARTITION BY isrc ORDER BY play_count DESC, id)) SELECT id AS track_a, best AS track_b, 'isrc' AS method, 'duplicate' AS relation, 1.0::DOUBLE AS score FROM r WHERE n >= 2 AND id <> best""")
def isrc_groups(spark, sf):
    return C.isrc_groups(_tracks(spark, sf))


@query(f"""WITH c AS ({_CUST}) SELECT id, (SELECT o.id FROM c o WHERE o.isrc = k.isrc ORDER BY o.play_count DESC, o.id LIMIT 1) AS canonical_id
    FROM c k WHERE EXISTS (SELECT 1 FROM c o WHERE o.isrc = k.isrc AND o.play_count > k.play_count)""")
def isrc_merge(spark, sf):
    return C.isrc_merge(_tracks(spark, sf))


@query("""WITH files AS (SELECT p_partkey AS file_id, p_name || p_size AS k, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_retailprice * 100 AS BIGINT) END AS d FROM part WHERE p_partkey % 2 = 1),
    cat AS (SELECT p_partkey AS id, p_name || p_size AS k, CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_retailprice * 100 AS BIGINT) END AS d FROM part WHERE p_partkey % 2 = 0),
    pairs AS (SELECT file_id, id, f.d AS fd, f.d IS NULL OR c.d IS NULL OR abs(f.d - c.d) <= 3000 AS fits FROM files f JOIN cat c USING (k)),
    kept AS (SELECT *, count(*) OVER (PARTITION BY file_id) AS n, count(*) FILTER (fits) OVER (PARTITION BY file_id) AS m FROM pairs),
    best AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY id) AS place, count(*) OVER (PARTITION BY file_id) AS candidates
        FROM kept WHERE NOT (n > 1 AND fd IS NOT NULL AND m > 0) OR fits)
    SELECT file_id, id, candidates, candidates > 1 AS ambiguous FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file_id DESC) AS turn FROM best WHERE place = 1) WHERE turn = 1""")
def match_files(spark, sf):
    rows = load(spark, sf, "part").select("p_partkey", F.concat("p_name", F.col("p_size").cast("string")).alias("norm_key"), (F.col("p_retailprice") * 100).cast("long").alias("d"))
    files = rows.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("file_id"), "norm_key", F.when(F.col("p_partkey") % 5 != 0, F.col("d")).alias("duration_ms"))
    tracks = rows.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), "norm_key", F.when(F.col("p_partkey") % 6 != 0, F.col("d")).alias("duration_ms"))
    return C.match_files(files, tracks)


#: Results that a search gives at most; each query's are a list of its own, found by key.
VETTED, SCORED = 15, 10


@query(f"""WITH pairs AS (SELECT s_suppkey AS query_id, c_custkey AS candidate_id, k AS pos, CASE WHEN abs(s_acctbal) >= 1 THEN abs(s_acctbal) / 10 END AS want, CASE WHEN c_custkey % 11 <> 0 THEN abs(c_acctbal) / 10 END AS got
    FROM supplier, range({VETTED}) r(k), customer WHERE c_custkey = s_suppkey * {VETTED} + k)
    SELECT query_id, candidate_id, pos, score FROM (SELECT query_id, candidate_id, pos, coalesce(greatest(0.0, 1 - abs(want - got) / want), 1.0) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY pos) AS turn FROM pairs WHERE coalesce(abs(want - got) <= 15, TRUE)) WHERE turn = 1""")
def vet_candidates(spark, sf):
    """Each supplier's search results are the customers of fifteen keys, in their order."""
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("query_id"), F.when(F.abs("s_acctbal") >= 1, F.abs("s_acctbal") / 10).alias("want_s"))
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("candidate_id"), F.when(F.col("c_custkey") % 11 != 0, F.abs("c_acctbal") / 10).alias("got_s"))
    found = s.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(VETTED - 1).cast("long")))).withColumn("candidate_id", F.col("query_id") * VETTED + F.col("pos"))
    return C.vet_candidates(found.join(c, "candidate_id"))


@query(f"""WITH q AS (SELECT p_partkey, lower(p_name) AS title, lower(p_type) AS artist, CAST(p_retailprice * 1000 AS BIGINT) AS d FROM part),
    pairs AS (SELECT a.p_partkey AS query_id, b.p_partkey AS candidate_id, k AS pos, a.title AS t, b.title AS ct, a.artist AS r, b.artist AS cr, a.d, b.d AS cd
        FROM q a, range(1, {SCORED + 1}) r(k), q b WHERE b.p_partkey = a.p_partkey + k * 7 AND b.p_partkey % 13 <> 0),
    scored AS (SELECT query_id, candidate_id, pos, 0.6 * len(list_intersect(string_split(t, ' '), string_split(ct, ' '))) / len(list_distinct(string_split(t, ' ') || string_split(ct, ' ')))
        + 0.4 * len(list_intersect(string_split(r, ' '), string_split(cr, ' '))) / len(list_distinct(string_split(r, ' ') || string_split(cr, ' ')))
        + CASE WHEN abs(d - cd) <= 5000 THEN 0.15 ELSE 0 END AS score FROM pairs)
    SELECT query_id, candidate_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) AS turn FROM scored) WHERE turn = 1 AND round(score, 9) >= 0.5""")
def score_candidates(spark, sf):
    """Each part's search results are ten parts of later keys."""
    part = load(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("title"), F.lower("p_type").alias("artist"), (F.col("p_retailprice") * 1000).cast("long").alias("duration_ms"))
    q = C.with_words(part)
    other = q.select(F.col("p_partkey").alias("candidate_id"), *[F.col(x).alias(f"c_{x}") for x in ("title_words", "artist_words", "duration_ms")], F.when(F.col("p_partkey") % 13 != 0, "u").alias("c_url"))
    found = q.withColumnRenamed("p_partkey", "query_id").withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(SCORED)))).withColumn("candidate_id", F.col("query_id") + F.col("pos") * 7)
    return C.score_candidates(found.join(other, "candidate_id"))


@query("""SELECT o_orderkey AS track_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def pending_work(spark, sf):
    """The work queue is a top 100 by weight of what has no row in the state table."""
    from tidemark.operators.state import pending

    done = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("track_id"), F.col("l_returnflag").alias("status"))
    work = load(spark, sf, "orders").select(F.col("o_orderkey").alias("track_id"), "o_totalprice")
    return pending(work, done.filter("status = 'R'"), "o_totalprice", 100).select("track_id")


@query("""SELECT o_custkey AS track_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS job_id FROM orders GROUP BY o_custkey""")
def latest_job(spark, sf):
    from tidemark.operators.state import latest

    jobs = load(spark, sf, "orders").select(F.col("o_custkey").alias("track_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("ts"))
    return latest(jobs, ["track_id"], ["ts", "job_id"]).select("track_id", "job_id")


@query("""SELECT c_custkey AS id, CASE WHEN o.k IS NULL THEN 'not_found' ELSE 'ok' END AS status, coalesce(o.v, 0.0) AS value FROM customer LEFT JOIN
    (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY 1) o ON c_custkey = o.k""")
def resolve_requested(spark, sf):
    found = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("v"))
    asked = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return asked.join(found, "id", "left").select("id", F.when(F.col("v").isNull(), "not_found").otherwise("ok").alias("status"), F.coalesce("v", F.lit(0.0)).alias("value"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 1 AS odd,
    coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def json_predicates(spark, sf):
    k = F.get_json_object("props", "$.k")
    return load(spark, sf, "events").filter(k.isNotNull()).select("event_id", k.alias("k"), (k.try_cast("long") % 2 == 1).alias("odd"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


@query("""SELECT page_id, regexp_extract(url, '([^/]+)/*$', 1) AS last, regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1) AS ext FROM pages""")
def url_parts(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.coalesce(X.last_segment(F.col("url")), F.lit("")).alias("last"), F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1).alias("ext"))
