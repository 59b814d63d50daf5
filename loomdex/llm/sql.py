"""DuckDB SQL of the queries that SQL can express."""

CURRICULUM_MIX = r"""
with sized as (
  select doc_id, source, md5(cast(doc_id as varchar)) as key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size
  from documents
), sources as (
  select source, cast(sum(size) as bigint) as source_size,
         row_number() over (order by source nulls last) - 1 as place
  from sized group by source
), weighed as (
  select *, [5, 2, 1][place % 3 + 1] as weight, 3 * source_size as cap from sources
), levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0))
          / (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0)) as level
  from weighed
), targets as (
  select source, source_size, place, least(cast(cap as double), weight * max(level) over ()) as target from levels
), placed as (
  select s.doc_id, s.size, t.source_size, t.target, t.place,
         cast(coalesce(sum(s.size) over (partition by s.source order by s.key, s.size rows between unbounded preceding and 1 preceding), 0) as bigint) as start
  from sized s join targets t on s.source is not distinct from t.source
), taken as (
  select *, cast(floor(target) as bigint) as budget from placed
), shares as (
  select *, case when size > 0 and start < budget then least((start + size / 2) / target, 1) end as share,
    case when size > 0 then greatest(0, least(size, budget - start)) + greatest(0, least(size, budget - start - source_size))
      + greatest(0, least(size, budget - start - 2 * source_size)) else 0 end as words,
    case when size > 0 then cast(start < budget as int) + cast(start + source_size < budget as int) + cast(start + 2 * source_size < budget as int) else 0 end as copies
  from taken
)
select doc_id, size, source_size, target, cast(words as bigint) as taken, copies,
  case when share is null then null
    when place % 3 = 1 then share
    when place % 3 = 0 then case when share * 2 < 1.25 then (1.5 - sqrt(greatest(2.25 - 2 * 0.5 * (share * 2), 0))) / 0.5 / 2
      else (1 + (1 - sqrt(greatest(1 - 2 * 0.5 * (share * 2 - 1.25), 0))) / 0.5) / 2 end
    else case when share * 2 < 0.75 then (sqrt(greatest(0.25 + 2 * 0.5 * (share * 2), 0)) - 0.5) / 0.5 / 2
      else (1 + (sqrt(greatest(1 + 2 * 0.5 * (share * 2 - 0.75), 0)) - 1) / 0.5) / 2 end
  end as position
from shares
"""

LINE_DEDUP = r"""
with docs as (
  select doc_id, text, string_split(text, chr(10)) as lines from documents
), rows as (
  select doc_id, pos, trim(lines[pos + 1], concat(' ', chr(9), chr(11), chr(12), chr(13))) as line
  from (select doc_id, lines, unnest(range(len(lines))) as pos from docs)
), kept as (
  select * from rows where length(line) >= 12
), firsts as (
  select line, min((doc_id, pos)) as first, length(line) as n from kept group by line
), halves as (
  select line, first, n, s, 0 as side, substring(line, n - (s - s // 2) + 1, s - s // 2) as part
  from (select *, unnest([n, n - 1]) as s from firsts)
  union all
  select line, first, n, s, 1, substring(line, 1, s // 2) from (select *, unnest([n, n - 1]) as s from firsts)
), near as (
  select distinct a.line from halves a join halves b
    on a.s = b.s and a.side = b.side and a.part = b.part and b.first < a.first and a.line <> b.line
  where abs(a.n - b.n) <= 1 and levenshtein(a.line, b.line) <= 1
), gone as (
  select k.doc_id, list(k.pos) as removed
  from kept k join firsts f on k.line = f.line left join near n on k.line = n.line
  where n.line is not null or (k.doc_id, k.pos) <> f.first
  group by k.doc_id
)
select d.doc_id, cast(coalesce(len(d.lines), 0) as bigint) as n_lines, cast(coalesce(len(g.removed), 0) as bigint) as n_removed,
  sha256(case when g.removed is null then coalesce(d.text, '') else coalesce(array_to_string(
    list_filter(list_transform(range(len(d.lines)), lambda i: case when list_contains(g.removed, i) then null else d.lines[i + 1] end), lambda x: x is not null), chr(10)), '') end) as text_sha256
from docs d left join gone g on d.doc_id = g.doc_id
"""

FILL_IN_MIDDLE = r"""
with units as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as digest,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u
  from documents
), drawn as (
  select doc_id, text, u, len(u) as n, list_transform([1, 9, 17, 25], lambda i: cast('0x' || substring(digest, i, 8) as bigint)) as h from units
), formed as (
  select *, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 50 then 'plain'
      when h[4] % 100 < 80 then 'spm' else 'psm' end as form,
    least(h[1] % (n + 1), h[2] % (n + 1)) as low, greatest(h[1] % (n + 1), h[2] % (n + 1)) as high
  from drawn
), parts as (
  select doc_id, text, n, form, array_to_string(u[1:low], '') as p, array_to_string(u[low + 1:high], '') as m, array_to_string(u[high + 1:], '') as s
  from formed
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'psm' then concat('<P>', p, '<S>', s, '<M>', m) when 'spm' then concat('<S>', s, '<P>', p, '<M>', m) else text end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""

SPELLING_VARIANTS = r"""
with recursive crc_table as (
  select list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), runs as (
  select run, concat(cast(doc_id as varchar), ':', run) as key, count(*) as times from (
    select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]{6,}')),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents)
  group by all
), bytes as (
  select run, times, flatten(list_transform(list_transform(range(1, length(key) + 1), lambda i: unicode(substring(key, i, 1))),
    lambda c: case when c < 128 then [c] else [192 + c // 64, 128 + c % 64] end)) as b from runs
), hashed as (
  select run, times, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) as h from bytes, crc_table
), damaged as (
  select case when h % 199 = 0 then concat(substring(run, 1, h % length(run)), substring(run, h % length(run) + 2)) else run end as word, times from hashed
), words as (
  select word, cast(sum(times) as bigint) as n from damaged where length(word) >= 6 group by word having sum(times) >= 5
), cut as (
  select word, n, unnest(range(1, length(word) + 1)) as place from words
), variants as (
  select word, n, place, concat(substring(word, 1, place - 1), substring(word, place + 1)) as less from cut
), near as (
  select a.word, b.word as other, b.n as m from variants a join variants b on a.place = b.place and a.less = b.less and a.word <> b.word
  union select a.word, b.word, b.n from words a join variants b on a.word = b.less
  union select b.word, a.word, a.n from words a join variants b on a.word = b.less
), best as (
  select word, count(*) as n_near, arg_min(other, (-m, other)) as other, max(m) as m from near group by word
), forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 5 * w.n then other end as form, case when m >= 5 * w.n then m end as form_n
  from words w left join best using (word)
), climbed as (
  select word, word as top, 0 as depth from forms
  union all
  select c.word, f.form, depth + 1 from climbed c join forms f on c.top = f.word where f.form is not null
), roots as (
  select word, arg_max(top, depth) as root from climbed group by word
)
select word, form, root, n, n_near, form_n from forms join roots using (word)
"""

SUBSTRING_DEDUP = r"""
with docs as (
  select row_number() over () as id, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents
), starts as (
  select id, place, md5(array_to_string(w[place:place + 34], ' ')) as key
  from (select id, w, unnest(range(1, len(w) - 33)) as place from docs where len(w) >= 35)
), repeated as (
  select id, place from starts qualify count(*) over (partition by key) > 1
), words as (
  select id, unnest(w) as word, unnest(range(1, len(w) + 1)) as place from docs
), marked as (
  select id, place, word, coalesce(place - max(r.start) over (partition by id order by place rows between unbounded preceding and current row) < 35, false) as gone
  from words left join (select id, place, place as start from repeated) r using (id, place)
), rest as (
  select id, count(*) as n_words, count(*) filter (gone) as n_removed, coalesce(string_agg(word, ' ' order by place) filter (not gone), '') as kept
  from marked group by id
)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from docs left join rest using (id)
"""


def license_scan(
    templates: list[tuple[str, str, int, float]], threshold: float, marker: str, token: str, blank: str, comments: list[str], spdx: str, spdx_name: str, spdx_term: str
) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    # Without the signs for "give nothing back" and "lines end in line feeds only", which are so here anyway.
    plain = lambda p: p.replace("*+", "*").replace("++", "+").replace("(?md)", "(?m)")
    rows = ",\n    ".join(f"({i}, {quoted(n)}, {quoted(t)}, {place}, {least})" for i, (n, t, place, least) in enumerate(templates))
    return rf"""
with files as (
  select doc_id as id, text, doc_id % 10 = 0 as named,
    concat(coalesce(source, 'none'), '/', cast(doc_id // 1000 as varchar)) as thousands,
    concat(coalesce(source, 'none'), '/', cast(doc_id // 1000 as varchar), '/', cast(doc_id // 100 as varchar)) as hundreds
  from documents
), placed as (
  select *, case when id % 100 = 0 then thousands else hundreds end as dir,
    case when named then concat(case when id % 100 = 0 then thousands else hundreds end, '/LICENSE.', cast(id as varchar))
      else concat(hundreds, '/text.', cast(id as varchar)) end as path
  from files
), templates(template, license, unit_text, place, least) as (
  values {rows}
), held as (
  select id, named, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{marker}')) as lines,
    list_filter(regexp_split_to_array(text, '{plain(blank)}'), lambda x: regexp_matches(x, '{marker}')) as paragraphs,
    list_filter(list_concat({", ".join(f"regexp_extract_all(text, {quoted(plain(c))})" for c in comments)}), lambda x: regexp_matches(x, '{marker}')) as remarks,
    flatten(list_transform(regexp_extract_all(lower(text), '{spdx}', 1), lambda x: regexp_extract_all(x, '{spdx_name}'))) as names
  from placed where text is not null and (named or regexp_matches(text, '{marker}'))
), listed as (
  select id, list_concat(
    list_distinct(list_transform(list_concat(case when named then [text] else [] end, [array_to_string(lines, chr(10))], lines,
      [array_to_string(paragraphs, chr(10) || chr(10))], paragraphs, remarks), lambda x: trim(x))),
    list_distinct(list_transform(list_filter(names, lambda x: x not in ('and', 'or', 'with')), lambda x: concat('{spdx_term}', regexp_replace(x, '-(only|or-later)$', ''))))) as units
  from held
), units as (
  select id, unnest(units) as unit_text, unnest(range(len(units))) as unit from listed
), words as (
  select id, unit, unnest(regexp_extract_all(lower(unit_text), '{token}')) as term from units
), terms as (
  select id, unit, term, count(*) as tf from words group by all
), template_terms as (
  select template, license, place, least, term, count(*) as tf
  from (select template, license, place, least, unnest(regexp_extract_all(lower(unit_text), '{token}')) as term from templates) group by all
), total as (
  select (select count(*) from (select distinct id, unit from terms)) + {len(templates)} as n
), idf as (
  select term, ln((1.0 + (select n from total)) / (1.0 + count(*))) + 1.0 as idf
  from (select term from terms union all select term from template_terms) group by term
), weighed as (
  select id, unit, term, tf * idf as w from terms join idf using (term)
), known as (
  select template, license, place, least, term, tf * idf as w from template_terms join idf using (term)
), norms as (select id, unit, sqrt(sum(w * w)) as norm from weighed group by all),
template_norms as (select template, sqrt(sum(w * w)) as norm from known group by all),
scored as (
  select u.id, k.license, k.place, k.least, round(sum(u.w * k.w) / any_value(n.norm * t.norm), 6) as score
  from weighed u join known k using (term) join norms n on u.id = n.id and u.unit = n.unit join template_norms t on k.template = t.template
  group by u.id, u.unit, k.template, k.license, k.place, k.least
), own as (
  select id, license, score from scored where score >= greatest({threshold}, least)
  qualify row_number() over (partition by id order by place, score desc, license) = 1
), stated as (
  select p.dir, o.license, o.score from placed p join own o using (id) where p.named
  qualify row_number() over (partition by p.dir order by o.score desc, o.license) = 1
)
select p.id as doc_id, p.path, coalesce(o.license, h.license, t.license) as license, coalesce(o.score, h.score, t.score) as score,
  case when o.id is not null then 'own' when coalesce(h.license, t.license) is not null then 'inherited' end as origin,
  case when o.id is null then coalesce(h.dir, t.dir) end as from_dir
from placed p left join own o using (id) left join stated h on h.dir = p.dir left join stated t on t.dir = p.thousands
"""


#: Components of links(a, b), both ways, for nodes(id): the smallest id within reach.
REACHED = """reached(id, other) as (
  select id, id from nodes
  union
  select r.id, l.b from reached r join links l on r.other = l.a
), components as (
  select id, min(other) as component_id from reached group by id
)"""

EMBEDDING_NEAR_DEDUP = f"""
with recursive sound as (
  select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where embedding is not null and vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), units as (
  select id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as u from sound
), nodes as (select vec_id as id from embeddings),
links as (
  select x.id as a, y.id as b from units x, units y
  where x.id <> y.id and len(x.u) = len(y.u) and list_dot_product(x.u, y.u) >= 0.9
), {REACHED}, counts as (select a as id, count(*) as n from links group by a)
select c.id as vec_id, coalesce(n, 0) as n_links, component_id, c.id = component_id as kept
from components c left join counts using (id)
"""

NGRAM_JACCARD = rf"""
with recursive split as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), sets as (
  select distinct doc_id, shingle from (
    select doc_id, array_to_string(w[i:i + 3], ' ') as shingle from (select doc_id, w, unnest(range(1, len(w) - 2)) as i from split where len(w) >= 4)
    union all
    select doc_id, array_to_string(w, ' ') from split where len(w) between 1 and 3)
), sizes as (select doc_id, count(*) as n from sets group by doc_id),
nodes as (select distinct doc_id as id from documents),
shared as (
  select x.doc_id as a, y.doc_id as b, count(*) as m from sets x join sets y on x.shingle = y.shingle and x.doc_id <> y.doc_id group by all
), links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * m >= 85 * (x.n + y.n - m)
), {REACHED}
select d.doc_id, coalesce(n, 0) as n_shingles, component_id
from documents d join components c on c.id = d.doc_id left join sizes s on s.doc_id = d.doc_id
"""
