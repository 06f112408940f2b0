"""The registered queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopatch.llm import byte_bpe, collocations, decontamination, divergence, language_id, licenses, line_dedup, secrets, simhash, spot_signatures, suffix_dedup, token_counts, warc
from geopatch.llm.common import read, sha256_of

#: Documents of more tokens than this are reported as over the limit.
TOKEN_LIMIT = 4096


def vocabulary(name: str) -> bytes:
    """The content of a public tokenizer's file, which the driver sends with the tasks (at most a few MB)."""
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document beside its edited text and the next document.  Null texts are empty, null ids have no next one, of repeated ids the least text is the next one."""
    return spot_signatures.compare_with_next(read(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and their classes.  Null and blank texts have fingerprint 0 and are linked like others; repeated rows are one node and two rows."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "copies")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and notices of each document.  Null texts have no words; ties of containment give all their labels; repeated rows give repeated rows."""
    return licenses.report(read(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the bytes decoded from them.  Null texts have no tokens; repeated rows give repeated rows."""
    return byte_bpe.round_trip(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of bytes and tokens.  Null texts count 0; repeated rows give repeated rows."""
    counted = token_counts.count_tokens(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items they hold.  Null texts hold none; rows with the same id and text give one row an item."""
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of removed lines, and the digest of what is left.  Null texts have no lines and a null digest; of equal lines the earliest stays, repeated rows keep the same ones."""
    left = line_dedup.dedup(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_exact", "n_near", sha256_of(F.col("text")).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents.  Null texts and those without letters are und; of equal scores the first label by name counts."""
    return language_id.identify(read(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of removed bytes, and the digest of what is left.  Null texts are empty; repeated rows repeat each other."""
    left = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of secrets.  Null texts have none; repeated rows give repeated rows."""
    found = secrets.scan(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["rank"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secrets.named(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.named(F.concat("base", "random")).alias("spans"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language.  Null texts have no words, a null language is und; ties go by phrase, repeated rows count as often as they stand."""
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as read back from their archives.  A null html is the empty payload; rows with the id and payload of a response are responses too."""
    return warc.report(read(spark, sf_dir, "pages"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the sources of each language, and their terms.  Nulls are empty strings, ties go by item, repeated rows count as often as they stand."""
    return divergence.audit(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that are left after all stages of the pipeline, as token ids.  Empty tables give no rows."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_spot_signatures, op2_simhash, op3_licenses, op4_byte_bpe, op5_token_counts, op6_decontamination, op7_line_dedup, op8_language_id, op9_suffix_dedup, op10_secrets, op11_collocations, op12_warc, op13_source_divergence, pipeline)}


def licenses_sql() -> str:
    """The license report, with every run of words against every notice."""
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    longest = max(len(p.split()) for p in licenses.PHRASES)
    follow = ", ".join(f"lead(word, {k}) over (partition by r order by pos) w{k}" for k in range(1, longest))
    cases = " ".join("when " + " and ".join(f"w{k} = '{w}'" for k, w in enumerate(p.split())) + f" then '{label}'" for p, label in licenses.PHRASES.items())
    notices = ", ".join(f"({k}, '{label}', '{w}', {len(set(t.split()))}, {licenses.block_words(t)}, {w in licenses.telling(t, licenses.TEMPLATES)}, {len(licenses.telling(t, licenses.TEMPLATES))})" for k, (t, label) in enumerate(licenses.TEMPLATES.items()) for w in sorted(set(t.split())))
    return f"""with d as (select row_number() over () r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
w as (select r, doc_id, regexp_extract_all(t, {word}) ws from d),
n(notice, label, word, size, reach, tells, telling) as (values {notices}),
e as (select r, unnest(ws) word, unnest(range(len(ws))) pos from w),
x as (select r, pos, word w0, {follow} from e),
y as (select r, list({{'at': pos, 'label': label}}) places from (select r, pos, case {cases} end label from x) where label is not null group by r),
p as (select w.r, doc_id, len(ws) n_words, coalesce(places, []) places from w left join y on w.r = y.r),
v as (select distinct r, word from e),
u as (select r, notice from v join n using (word) group by r, notice, size having count(*) >= ceil({licenses.THRESHOLD} * size - 1e-9)),
g as (select u.r, n.* from u join n using (notice)),
c as (select g.*, e.pos from g join e on g.r = e.r and g.word = e.word),
b as (select a.r, a.notice, a.label, a.pos, a.size, max(z.pos) last, count(distinct z.word) shared from c a join c z on a.r = z.r and a.notice = z.notice and z.pos between a.pos and a.pos + a.reach - 1
  group by a.r, a.notice, a.label, a.pos, a.size, a.telling having count(distinct z.word) filter (z.tells) = a.telling and count(distinct z.word) >= ceil({licenses.THRESHOLD} * a.size - 1e-9)),
k as (select *, (shared * 1000000000 // size) * 1000000 + size * 1000 + 999 - notice as rank, (pos + last) // 2 middle from b),
o as (select r, spot, max(rank) best from (select r, rank, unnest(range(pos, last + 1)) spot from k) group by r, spot),
m as (select k.r, list(distinct label) labels, max(shared / cast(size as double)) best from k join o on k.r = o.r and k.middle = o.spot and k.rank >= o.best group by k.r)
select doc_id, cast(n_words as bigint) n_words, cast(len(places) as bigint) n_base, cast(list_min(list_transform(places, lambda x: x['at'])) as bigint) first_word, cast(list_max(list_transform(places, lambda x: x['at'])) as bigint) last_word,
  array_to_string(list_sort(list_distinct(list_transform(places, lambda x: x['label']))), ',') base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(places, lambda x: x['label']), coalesce(labels, [])))), ',') labels,
  case when len(places) > 0 then cast(1 as double) else coalesce(best, cast(0 as double)) end score
from p left join m using (r)"""


LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

COLLOCATIONS_SQL = rf"""with d as (select row_number() over () r, coalesce(lang, 'und') lang, {LOWER.format("coalesce(text, '')")} t from documents),
p as (select r, lang, unnest(ps) piece, unnest(range(len(ps))) p from (select r, lang, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') ps from d)),
w as (select r, lang, p, unnest(ws) w, unnest(range(len(ws))) k from (select r, lang, p, regexp_extract_all(piece, '[^\x20\x09]+') ws from p)),
g as (select lang, w, lead(w, 1) over q w1, lead(w, 2) over q w2 from w window q as (partition by r, p order by k)),
f1 as (select lang, w, count(*) f from g group by all),
f2 as (select lang, w, w1, count(*) f from g where w1 is not null group by all),
f3 as (select lang, w, w1, w2, count(*) f from g where w2 is not null group by all having count(*) >= 10),
n as (select lang, count(*) n from w group by lang),
c3 as (select t.lang, t.w || ' ' || t.w1 || ' ' || t.w2 phrase, t.f a, a.f la, b.f ra, c.f lb, e.f rb, cast(1000000 as hugeint) * t.f * t.f // (cast(a.f as hugeint) * b.f) sa, cast(1000000 as hugeint) * t.f * t.f // (cast(c.f as hugeint) * e.f) sb
  from f3 t join f1 a on a.lang = t.lang and a.w = t.w join f2 b on b.lang = t.lang and b.w = t.w1 and b.w1 = t.w2 join f2 c on c.lang = t.lang and c.w = t.w and c.w1 = t.w1 join f1 e on e.lang = t.lang and e.w = t.w2),
x as (select lang, w, w1, max(f) longer from (select lang, w, w1, f from f3 union all select lang, w1, w2, f from f3) group by all),
c2 as (select t.lang, t.w || ' ' || t.w1 phrase, t.f a, a.f l, b.f r, cast(1000000 as hugeint) * t.f * t.f // (cast(a.f as hugeint) * b.f) score
  from f2 t join f1 a on a.lang = t.lang and a.w = t.w join f1 b on b.lang = t.lang and b.w = t.w1 left join x on x.lang = t.lang and x.w = t.w and x.w1 = t.w1 where t.f >= 10 and (longer is null or 100 * longer < 50 * t.f)),
c as (select * from c2 union all select lang, phrase, a, case when sb < sa then lb else la end, case when sb < sa then rb else ra end, least(sa, sb) from c3),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) k from c)
select lang, k as rank, phrase, a, l, r, n, cast(score as bigint) score from o join n using (lang) where k <= 2000"""

WARC_SQL = """with p as (select page_id, encode(coalesce(html, '')) b from pages),
d as (select page_id, octet_length(b) payload_bytes, sha256(b) payload_digest from p),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end least from d)
select page_id, cast(payload_bytes as bigint) payload_bytes, payload_digest, case when least is null or page_id = least then 'response' else 'revisit' end record_type, case when page_id <> least then least end refers_to from f"""

DIVERGENCE_SQL = rf"""with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source, {LOWER.format("coalesce(text, '')")} t from documents),
w as (select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
k as (select lang, term from w group by all having count(distinct r) >= 30),
v as (select lang, count(*) v from k group by lang),
c as (select lang, source, term, count(*) n from w join k using (lang, term) group by all),
g as (select g.lang, g.source, coalesce(v, 0) v, coalesce(s, 0) s from (select distinct lang, source from d) g left join v using (lang) left join (select lang, source, sum(n) s from c group by all) using (lang, source)),
m as (select g.lang, g.source, k.term, coalesce(n, 0) n, cast(1 + cast(1000000000 as hugeint) * (coalesce(n, 0) + 5) // (s + 5 * v) as bigint) p from g join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (select lang, term, cast(1 + cast(1000000000 as hugeint) * (sum(n) + 5) // (sum(sum(n)) over (partition by lang) + 5 * max(v)) as bigint) q from m join v using (lang) group by lang, term),
t as (select lang, source, 'term' part, term item, p - q as value from m join q using (lang, term) where n > 0 and p > q),
z as (select a.lang, a.source, b.source other, sum(abs(a.p - b.p)) as value from m a join m b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
o as (select a.lang, a.source, 'pair' part, b.source item, coalesce(z.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join z on z.lang = a.lang and z.source = a.source and z.other = b.source),
x as (select *, row_number() over (partition by lang, source, part order by value desc, item) k from (select * from t union all select * from o))
select lang, source, part, item, cast(value as bigint) as value, cast(k as int) as rank from x where part = 'pair' or k <= 50"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the others are held against plain versions in the tests."""
    return {"op3_licenses": licenses_sql(), "op11_collocations": COLLOCATIONS_SQL, "op12_warc": WARC_SQL, "op13_source_divergence": DIVERGENCE_SQL}
