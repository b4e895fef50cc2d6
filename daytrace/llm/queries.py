"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codes import token_files
from .common import Scratch, read
from .langid import held_out, identify, learn_dictionaries
from .lattice import link_vectors
from .lines import dedup_lines
from .minhash import link_texts
from .mixing import mix
from .packing import pack
from .phrases import collocations
from .sharding import assign_shards
from .tokens import count_tokens
from .topk import top_k
from .warc import read_archive, write_archive
from .whitening import whiten

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of near equal bytes over all documents."""
    return assign_shards(read(spark, sf_dir, "documents"), Scratch(spark, "op1"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as a content-addressed archive and read back."""
    path = f"{Scratch(spark, 'op2').folder}/archive"
    write_archive(read(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"
    )


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for every hundredth vector."""
    return top_k(read(spark, sf_dir, "embeddings"), Scratch(spark, "op3"))


def op4_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal label."""
    return link_vectors(read(spark, sf_dir, "embeddings"), Scratch(spark, "op4"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack(read(spark, sf_dir, "documents"), TOKENIZER, Scratch(spark, "op5"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three of four."""
    docs = read(spark, sf_dir, "documents")
    dictionaries = learn_dictionaries(docs.where(~held_out()))
    return identify(docs, dictionaries, keep=("doc_id", held_out().alias("held_out"))).drop("rejected")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mixture takes of each document, and where in the schedule."""
    _, result = mix(read(spark, sf_dir, "documents"), Scratch(spark, "op7"))
    return result.drop("row")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that at least ten sources share, but for one copy each."""
    out = dedup_lines(read(spark, sf_dir, "documents"), Scratch(spark, "op8"))
    return out.select(
        "doc_id",
        "lines",
        "removed",
        F.char_length("text").cast("long").alias("kept_chars"),
        F.md5("text").alias("kept_md5"),
    )


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents by runs of four words."""
    return link_texts(read(spark, sf_dir, "documents"), Scratch(spark, "op9"), shingle=4)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, from its prefix table."""
    return count_tokens(read(spark, sf_dir, "documents"), TOKENIZER, steps=False)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors along their four leading components.  A deviation that exceeds 64 bits is null here;
    the operator returns it as a decimal."""
    out = whiten(read(spark, sf_dir, "embeddings"), Scratch(spark, "op11"))
    return out.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases that hold together best in each language."""
    return collocations(read(spark, sf_dir, "documents"), Scratch(spark, "op12"))


def op13_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written in directly addressable codes and read back."""
    return token_files(read(spark, sf_dir, "documents"), TOKENIZER, Scratch(spark, "op13"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sampled_splitters,
        op2_warc,
        op3_exact_top_k,
        op4_lattice_dedup,
        op5_best_fit_packing,
        op6_language_id,
        op7_mixing,
        op8_line_dedup,
        op9_minhash_dedup,
        op10_token_counts,
        op11_whitening,
        op12_collocations,
        op13_token_codes,
    )
}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ORACLES = {
    "op2_warc": f"""
with r as (
  select page_id, encode(coalesce(html, '')) as payload from pages),
d as (
  select page_id, octet_length(payload) as n, sha1(payload) as hex, min(page_id) over (partition by payload) as first
  from r),
x as (
  select *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, cast(i * 5 + 1 as int), 5))::bigint) as quints from d)
select page_id, cast(n as bigint) as payload_bytes,
  list_aggregate(list_transform(quints, lambda q:
    substr('{_BASE32}', cast((q >> 15) & 31 as int) + 1, 1) || substr('{_BASE32}', cast((q >> 10) & 31 as int) + 1, 1) ||
    substr('{_BASE32}', cast((q >> 5) & 31 as int) + 1, 1) || substr('{_BASE32}', cast(q & 31 as int) + 1, 1)),
    'string_agg', '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to, true as verified
from x""",
    "op3_exact_top_k": """
with t as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null),
e as (select vec_id, unnest(v) as w, generate_subscripts(v, 1) as term from t),
s as (
  select q.vec_id as query_id, c.vec_id, cast(sum(q.w * c.w) as bigint) as score
  from e q join e c on q.term = c.term and q.vec_id % 100 = 0 and q.vec_id <> c.vec_id group by 1, 2),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10""",
    "op4_lattice_dedup": """
with recursive n as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where label is not null and embedding is not null),
u as (select *, sqrt(list_inner_product(v, v)) as norm from n),
l as (
  select a.vec_id as x, b.vec_id as y from u a join u b on a.label = b.label and a.vec_id <> b.vec_id
  where a.norm > 0 and b.norm > 0 and list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
r as (select x, y from l union select r.x, l.y from r join l on r.y = l.x)
select e.vec_id, coalesce(any_value(d.n), 0) as n_links, least(e.vec_id, coalesce(min(r.y), e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce(min(r.y), e.vec_id)) as kept
from embeddings e left join (select x, count(*) as n from l group by 1) d on d.x = e.vec_id
left join r on r.x = e.vec_id group by e.vec_id""",
    "op7_mixing": r"""
with recursive d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5(cast(doc_id as varchar)) as h
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size,
    (row_number() over (order by source collate "binary" nulls last) - 1) % 3 + 1 as weight from d group by source),
lv as (
  select 0 as step, cast((select sum(source_size) from s) as bigint) as rest, cast((select sum(weight) from s) as bigint) as weight
  union all
  select * from (
    select lv.step + 1 as step,
      cast((select sum(source_size) from s) - coalesce((select sum(3 * source_size) from s where 3 * source_size * lv.weight < s.weight * lv.rest), 0) as bigint) as rest,
      cast((select sum(s.weight) from s where not (3 * source_size * lv.weight < s.weight * lv.rest)) as bigint) as weight
    from lv) z where z.step < 40),
f as (select rest, weight from lv order by step desc limit 1),
t as (
  select s.source, source_size, case when 3 * source_size * f.weight < s.weight * f.rest then cast(3 * source_size as double)
    else cast(s.weight * f.rest as double) / cast(f.weight as double) end as target from s, f),
p as (
  select d.*, coalesce(sum(size) over (partition by source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0) as start from d),
u as (
  select *, cast(floor(target) as bigint) as due, (source_size + 1023) // 1024 as blocks,
    (cast(floor(target) as bigint) // source_size) * ((source_size + 1023) // 1024) + (cast(floor(target) as bigint) % source_size + 1023) // 1024 as need
  from t where source_size > 0),
a as (
  select *, cast(coalesce(sum(need) over (order by source collate "binary" nulls last rows between unbounded preceding and 1 preceding), 0) as bigint) as lo
  from u where need > 0),
n as (select cast(coalesce(sum(need), 0) as bigint) as n from a),
x as (
  select i as slot, cast((((cast(i as hugeint) * 618033988749894848) % 1000000000000000000) * n) // 1000000000000000000 as bigint) as x
  from (select n, unnest(range(n)) as i from n)),
h as (
  select slot, lo, need, row_number() over (partition by lo order by slot) - 1 as k from x join a on x.x >= lo and x.x < lo + need),
v as (select slot, row_number() over (order by slot) as r from h where k >= need),
m as (
  select lo, k, row_number() over (order by lo, k) as r from (
    select a.lo, unnest(range(coalesce(c.have, 0), a.need)) as k from a left join (select lo, count(*) as have from h group by lo) c on a.lo = c.lo)),
sl as (select lo, k, slot from h where k < need union all select m.lo, m.k, v.slot from m join v on m.r = v.r),
q as (
  select doc_id, source, start, size, unnest(range(cast(start // 1024 as bigint), cast((start + size - 1) // 1024 + 1 as bigint))) as b from p where size > 0),
mx as (
  select q.doc_id, sl.slot,
    least(q.start + q.size, q.b * 1024 + least(1024, a.source_size - q.b * 1024, a.due - (sl.k // a.blocks * a.source_size + q.b * 1024)))
      - greatest(q.start, q.b * 1024) as words
  from q join a on q.source is not distinct from a.source join sl on sl.lo = a.lo and sl.k % a.blocks = q.b),
z as (select doc_id, cast(sum(words) as bigint) as taken, min(slot) as first_slot, count(*) as n_slots from mx where words > 0 group by doc_id)
select p.doc_id, size, source_size, target, coalesce(taken, 0) as taken, first_slot, coalesce(n_slots, 0) as n_slots
from p join t on p.source is not distinct from t.source left join z on p.doc_id = z.doc_id""",
    "op8_line_dedup": r"""
with l as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents where text is not null),
c as (
  select line, min({'d': doc_id, 'p': pos}) as first from l
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by line having count(distinct source) >= 10),
k as (
  select l.*, c.line is not null and (l.doc_id <> c.first.d or l.pos <> c.first.p) as gone
  from l left join c on l.line = c.line),
g as (
  select doc_id, count(*) as lines, count(*) filter (gone) as removed,
    coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as kept from k group by doc_id)
select d.doc_id, coalesce(lines, 0) as lines, coalesce(removed, 0) as removed, cast(length(kept) as bigint) as kept_chars, md5(kept) as kept_md5
from documents d left join g on d.doc_id = g.doc_id""",
    "op9_minhash_dedup": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents),
g as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) end as gs from w),
n as (select doc_id, cast(len(gs) as bigint) as n_shingles from g),
e as (select doc_id, hash(unnest(gs)) as s from g),
p as (
  select a.doc_id as x, b.doc_id as y, count(*) as common from e a join e b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (
  select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y
  where 100 * common >= 80 * (a.n_shingles + b.n_shingles - common)),
m as (select x, y from l union all select y, x from l),
r as (select x, y from m union select r.x, m.y from r join m on r.y = m.x)
select n.doc_id, any_value(n_shingles) as n_shingles, least(n.doc_id, coalesce(min(r.y), n.doc_id)) as component_id,
  n.doc_id = least(n.doc_id, coalesce(min(r.y), n.doc_id)) as kept
from n left join r on r.x = n.doc_id group by n.doc_id""",
    "op12_collocations": r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
n as (select lang, cast(sum(len(ws)) as bigint) as n from w group by lang),
g as (
  select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase
  from w, (select unnest([1, 2, 3, 4]) as k) where len(ws) >= k),
f as (select lang, k, phrase, cast(count(*) as bigint) as a from g group by all having count(*) >= 30),
c as (
  select f.*, j, array_to_string(string_split(phrase, ' ')[:j], ' ') as head, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') as tail
  from f, (select unnest([1, 2, 3]) as j) where j < k),
s as (
  select c.lang, c.phrase, c.k, c.a, min({'score': cast(cast(2000000 as hugeint) * c.a // (h.a + t.a) as bigint), 'j': j, 'l': h.a, 'r': t.a}) as cut
  from c join f h on h.lang = c.lang and h.phrase = c.head join f t on t.lang = c.lang and t.phrase = c.tail group by all),
i as (
  select lang, a, array_to_string(string_split(phrase, ' ')[x:x + m - 1], ' ') as phrase
  from f, (select unnest([2, 3]) as m), (select unnest([1, 2, 3]) as x) where m < k and x + m - 1 <= k),
b as (select lang, phrase, max(a) as around from i group by all),
r as (
  select s.lang, row_number() over (partition by s.lang order by cut.score desc, s.a desc, s.phrase collate "binary") as rank,
    s.phrase, s.a, cut.l as l, cut.r as r, cut.score as score
  from s left join b on b.lang = s.lang and b.phrase = s.phrase where around is null or 100 * around < 80 * s.a)
select r.lang, rank, phrase, a, l, r, n, score from r join n on n.lang = r.lang where rank <= 2000""",
}
