"""SQL for queries whose operators fold over one document, page or figure: recursive tables with one row per step.

Boxes are lists [x0, y0, x1, y1] of numbers counted from 1.
"""

from __future__ import annotations

from folioscope.functions import patterns as P
from folioscope.plans import fixtures as X

_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_STRIP = lambda c: f"regexp_replace({c}, '^{_WHITE}+|{_WHITE}+$', '', 'g')"
_AROUND = lambda a, b: f"[least({a}[1], {b}[1]), least({a}[2], {b}[2]), greatest({a}[3], {b}[3]), greatest({a}[4], {b}[4])]"
_MEETS = lambda a, b: f"greatest({a}[1], {b}[1]) < least({a}[3], {b}[3]) and greatest({a}[2], {b}[2]) < least({a}[4], {b}[4])"
_AREA = lambda b: f"abs(({b}[3] - {b}[1]) * ({b}[4] - {b}[2]))"

PAIR_CAPTIONS = f"""
with recursive base as (select doc_id, pos from {X.LINES}),
r as (select doc_id, cast(pos as int) as idx, row_number() over (partition by doc_id order by pos) as i, 1 + pos % 3 as page,
             (doc_id * pos) % 50 as x0, pos * 10 as y0, (doc_id * pos) % 50 + 60 as x1, pos * 10 + 30 as y1 from base where pos % 2 = 0),
c as (select doc_id, cast(pos + 1 as int) as num, row_number() over (partition by doc_id order by pos) as k, 1 + (pos + doc_id) % 3 as page,
             (doc_id + pos) % 40 as x0, pos * 10 + 31 as y0, (doc_id + pos) % 40 + 70 as x1, pos * 10 + 40 as y1 from base where pos % 3 = 0),
near as (select r.doc_id, r.i, list(c.k order by least(abs(c.y0 - r.y1), abs(r.y0 - c.y1)), c.k) as ks
         from r join c on c.doc_id = r.doc_id and c.page = r.page and least(r.x1, c.x1) - greatest(r.x0, c.x0) > {P.PAIR_OVERLAP} * least(r.x1 - r.x0, c.x1 - c.x0) group by all),
todo as (select r.doc_id, r.i, coalesce(ks, []) as ks from r left join near on near.doc_id = r.doc_id and near.i = r.i),
step as (select doc_id, 0::bigint as i, []::bigint[] as taken, null::bigint as k from (select distinct doc_id from r)
         union all
         select doc_id, i, case when k is null then taken else list_append(taken, k) end, k
         from (select s.doc_id, t.i, s.taken, list_filter(t.ks, lambda x: not list_contains(s.taken, x))[1] as k from step s join todo t on t.doc_id = s.doc_id and t.i = s.i + 1)),
left_r as (select doc_id, i, row_number() over (partition by doc_id order by i) as n from step where i > 0 and k is null),
left_c as (select c.doc_id, c.k, row_number() over (partition by c.doc_id order by c.k) as n from c where not exists (select 1 from step s where s.doc_id = c.doc_id and s.k = c.k))
select r.doc_id, r.idx, c.num from r join step s on s.doc_id = r.doc_id and s.i = r.i
left join left_r on left_r.doc_id = r.doc_id and left_r.i = r.i left join left_c on left_c.doc_id = r.doc_id and left_c.n = left_r.n
left join c on c.doc_id = r.doc_id and c.k = coalesce(s.k, left_c.k)
"""

FIGURE_REGIONS = f"""
with recursive base as (select doc_id, pos, line, cast(floor(pos / 6) as int) + 1 as page from {X.LINES}),
art as (select doc_id, page, pos, case when pos % 4 = 0 then 0 else 1 end as drawing, cast((doc_id * 7 + pos * 131) % 480 as double) as x0, cast((doc_id * 3 + pos * 97) % 600 as double) as y0 from base),
sized as (select *, [x0, y0, x0 + 3 + (pos * 29) % 150, y0 + 3 + (pos * 41) % 120] as box from art),
listed as (select doc_id, page, list(box order by drawing, pos) as boxes from sized where drawing = 0 or (box[3] - box[1] > 4 and box[4] - box[2] > 4) group by all),
fold as (
  select doc_id, page, boxes as todo, null::double[] as box, []::double[][] as done from listed
  union all
  select doc_id, page, case when box is null then todo[2:] else todo end,
         case when box is null then todo[1] when hit is not null then {_AROUND("box", "done[hit]")} end,
         case when box is null then done when hit is null then list_append(done, box) else list_concat(done[1 : hit - 1], done[hit + 1 :]) end
  from (select *, [box[1] - {P.REGION_GAP}, box[2] - {P.REGION_GAP}, box[3] + {P.REGION_GAP}, box[4] + {P.REGION_GAP}] as wide,
               list_filter(range(1, len(done) + 1), lambda k: {_MEETS("[box[1] - %d, box[2] - %d, box[3] + %d, box[4] + %d]" % ((P.REGION_GAP,) * 4), "done[k]")})[1] as hit
        from fold where box is not null or len(todo) > 0)),
clusters as (select doc_id, page, unnest(done) as box, unnest(range(1, len(done) + 1)) as k from fold where box is null and len(todo) = 0),
kept as (select *, [box[1] - {2 * P.REGION_GAP}, box[2] - {2 * P.REGION_GAP}, box[3] + {2 * P.REGION_GAP}, box[4] + {2 * P.REGION_GAP}] as reach from clusters where {_AREA("box")} >= {P.REGION_SHARE}::double * 480000),
blocks as (select doc_id, page, pos, cast((doc_id * 5 + pos * 61) % 520 as double) as x0, cast((doc_id + pos * 151) % 760 as double) as y0, line from base),
texts as (select doc_id, page, [x0, y0, x0 + 40, y0 + 12] as rect from blocks where length({_STRIP("line")}) <= {P.REGION_LABEL_CHARS}),
met as (select k.doc_id, k.page, k.k, t.rect, [greatest(reach[1], rect[1]), greatest(reach[2], rect[2]), least(reach[3], rect[3]), least(reach[4], rect[4])] as part
        from kept k join texts t on t.doc_id = k.doc_id and t.page = k.page),
grown as (select doc_id, page, k, min(rect[1]) as x0, min(rect[2]) as y0, max(rect[3]) as x1, max(rect[4]) as y1 from met
          where part[1] <= part[3] and part[2] <= part[4] and {_AREA("part")} >= {P.REGION_INSIDE} * {_AREA("rect")} group by all),
final as (select k.doc_id, k.page, k.k, greatest(least(box[1], coalesce(g.x0, box[1])), 0.0) as x0, greatest(least(box[2], coalesce(g.y0, box[2])), 0.0) as y0,
                 least(greatest(box[3], coalesce(g.x1, box[3])), 600.0) as x1, least(greatest(box[4], coalesce(g.y1, box[4])), 800.0) as y1
          from kept k left join grown g on g.doc_id = k.doc_id and g.page = k.page and g.k = k.k)
select doc_id, page, cast(row_number() over (partition by doc_id, page order by y0, x0, k) - 1 as int) as idx, cast(x0 as double) as x0, cast(y0 as double) as y0, cast(x1 as double) as x1, cast(y1 as double) as y1 from final
"""

_CELLS = "(select fig_id, rows, cols, unnest(range(0, rows * cols)) as k from (select doc_id as fig_id, 2 + doc_id % 2 as rows, 2 + doc_id % 3 as cols from documents))"
_CROPS = f"(select fig_id, k, {', '.join(f'cast({e} as int) as {c}' for c, e in X.CROP.items())} from {_CELLS})"

READING_ORDER = f"""
with recursive crops as (select *, row_number() over (partition by fig_id order by y0, x0, k) as i from {_CROPS}),
step as (select fig_id, 0::bigint as i, []::struct(t int, b int)[] as rows, null::bigint as h from (select distinct fig_id from crops)
         union all
         select fig_id, i, case when h is null then list_append(rows, {{t: y0, b: y1}})
                                else list_concat(rows[1 : h - 1], [{{t: least(rows[h].t, y0), b: greatest(rows[h].b, y1)}}], rows[h + 1 :]) end, coalesce(h, len(rows) + 1)
         from (select s.fig_id, c.i, s.rows, c.y0, c.y1,
                      list_filter(range(1, len(s.rows) + 1), lambda n: least(s.rows[n].b, c.y1) - greatest(s.rows[n].t, c.y0) > 0.5 * least(s.rows[n].b - s.rows[n].t, c.y1 - c.y0))[1] as h
               from step s join crops c on c.fig_id = s.fig_id and c.i = s.i + 1)),
joined as (select c.*, s.h, min(c.y0) over (partition by c.fig_id, s.h) as top from crops c join step s on s.fig_id = c.fig_id and s.i = c.i),
placed as (select *, row_number() over (partition by fig_id order by top, h, x0, i) - 1 as place from joined)
select fig_id, chr(cast(97 + place as int)) as name, cast(place as int) as place, x0, y0, x1, y1 from placed
"""

_GAP = "greatest(0, greatest(a[1], b[1]) - least(a[3], b[3])) ** 2 + greatest(0, greatest(a[2], b[2]) - least(a[4], b[4])) ** 2"


def merge_to_count(labels: str) -> str:
    """``labels`` are common tables that define labels (fig_id, label, box)."""
    gap = _GAP.replace("a[", "boxes[i][").replace("b[", "boxes[j][")
    return f"""
with recursive {labels},
listed as (select fig_id, list([x0, y0, x1, y1] order by k) as boxes from {_CROPS} group by fig_id),
spots as (select fig_id, list([(x0 + x1) / 2, (y0 + y1) / 2]) as spots from labels group by fig_id),
aims as (select doc_id as fig_id, {X.TARGET} as target from (select doc_id, 2 + doc_id % 2 as rows, 2 + doc_id % 3 as cols from documents)),
step as (
  select l.fig_id, target, coalesce(spots, []) as spots, boxes, false as stuck from listed l join aims a on a.fig_id = l.fig_id left join spots s on s.fig_id = l.fig_id
  union all
  select fig_id, target, spots, case when p is null then boxes else list_append(list_filter(boxes, lambda b, n: n <> p.i and n <> p.j), {_AROUND("boxes[p.i]", "boxes[p.j]")}) end, p is null
  from (select *, list_sort(list_filter(flatten(list_transform(range(1, len(boxes) + 1), lambda i: list_transform(range(i + 1, len(boxes) + 1), lambda j: {{gap: {gap}, i: i, j: j}}))), lambda q: not (own[q.i] and own[q.j])))[1] as p
        from (select *, list_transform(boxes, lambda b: len(list_filter(spots, lambda s: b[1] <= s[1] and s[1] < b[3] and b[2] <= s[2] and s[2] < b[4])) > 0) as own
              from step where not stuck and len(boxes) > target))),
last as (select fig_id, boxes from step where stuck or len(boxes) <= target qualify row_number() over (partition by fig_id order by len(boxes)) = 1),
out as (select fig_id, unnest(boxes) as b, unnest(range(0, len(boxes))) as idx from last)
select fig_id, cast(idx as int) as idx, b[1] as x0, b[2] as y0, b[3] as x1, b[4] as y1 from out
"""


_MENTION = r"(?:图|图表|Fig(?:ure)?\.?)\s*([0-9]+)"
_BEFORE = r"(?i:补充|附录|附|扩展数据|Supplementary|Extended\s+Data|SI)\s*"

RELOCATE = rf"""
with recursive texts as (select doc_id, string_agg(line, chr(10) || chr(10) order by pos) as text from (select doc_id, pos, {X.RELOCATE} as line from {X.LINES}) group by doc_id),
s as (select doc_id, regexp_split_to_array(text, '\n\s*\n') as a from texts),
c as (select doc_id, i, chunk, {_STRIP("chunk")} as bare from (select doc_id, unnest(range(1, len(a) + 1)) as i, unnest(a) as chunk from s)),
im as (select *, regexp_matches(bare, '{P.re2("IMAGE_CHUNK")}') as image, regexp_extract(bare, '{P.re2("IMAGE_CHUNK")}', 1) as alt, regexp_extract(regexp_extract(bare, '{P.re2("IMAGE_CHUNK")}', 2), '([^/]*)$', 1) as file from c),
n as (select *, case when image then coalesce(try_cast(nullif(regexp_extract(alt, '{P.re2("FIGURE_IN_CAPTION")}', 1), '') as int), try_cast(nullif(regexp_extract(file, '{P.re2("FIGURE_IN_PATH")}', 1), '') as int)) end as number,
             case when regexp_matches(bare, '{P.re2("HEADING_CHUNK")}') then try_cast(nullif(regexp_extract(chunk, '{P.re2("FIGURE_IN_CAPTION")}', 1), '') as int) end as titled from im),
whole as (select doc_id, list({{number: number, titled: titled}} order by i) as cs from n group by doc_id),
step as (
  select doc_id, 0::bigint as i, []::bigint[] as body, null::int as opened, []::struct(number int, chunk_at bigint)[] as figs from whole
  union all
  select doc_id, i + 1, case when number is null then list_append(body, i + 1) when adopts then body[: len(body) - 1] else body end, number,
         case when number is null then figs when adopts then list_concat(figs, [{{number: number, chunk_at: body[-1]}}, {{number: number, chunk_at: i + 1}}]) else list_append(figs, {{number: number, chunk_at: i + 1}}) end
  from (select s.*, w.cs[s.i + 1].number as number, w.cs[s.i + 1].number is distinct from s.opened and len(s.body) > 0 and coalesce(w.cs[s.body[-1]].titled = w.cs[s.i + 1].number, false) as adopts
        from step s join whole w on w.doc_id = s.doc_id and s.i < len(w.cs))),
last as (select step.* from step join whole w on w.doc_id = step.doc_id and step.i = len(w.cs)),
figs as (select doc_id, f.number as number, f.chunk_at as chunk_at, k from (select doc_id, unnest(figs) as f, unnest(range(0, len(figs))) as k from last)),
body as (select n.doc_id, n.i, n.chunk, n.bare, n.image, regexp_matches(n.bare, '(?s)^(```.*```|~~~.*~~~)\s*$') as fenced,
                n.bare <> '' and not n.image and not regexp_matches(n.bare, '{P.re2("HEADING_CHUNK")}') as host
         from (select doc_id, unnest(body) as i from last) b join n on n.doc_id = b.doc_id and n.i = b.i where not regexp_matches(n.bare, '{P.re2("EMPTY_FIGURE_HEADING")}')),
said as (select doc_id, i, regexp_extract_all(bare, '{_MENTION}', 1) as every, regexp_extract_all(bare, '{_BEFORE}{_MENTION}', 1) as other from body where host),
wanted as (select doc_id, number, row_number() over (partition by doc_id order by number) as r from (select distinct doc_id, number from figs)),
near as (select w.doc_id, w.r, list(s.i order by s.i) as hosts from wanted w join said s on s.doc_id = w.doc_id and len(list_filter(every, lambda x: x = w.number::varchar)) > len(list_filter(other, lambda x: x = w.number::varchar)) group by all),
todo as (select w.doc_id, w.number, w.r, coalesce(hosts, []) as hosts from wanted w left join near on near.doc_id = w.doc_id and near.r = w.r),
place as (
  select doc_id, 0::bigint as r, null::int as number, []::bigint[] as taken, null::bigint as host from (select distinct doc_id from wanted)
  union all
  select doc_id, r, number, case when host is null then taken else list_append(taken, host) end, host
  from (select t.doc_id, t.r, t.number, p.taken, list_filter(t.hosts, lambda x: not list_contains(p.taken, x))[1] as host from place p join todo t on t.doc_id = p.doc_id and t.r = p.r + 1)),
ends as (select p.doc_id, p.number, p.host, (select max(b.i) from body b where b.doc_id = p.doc_id and b.i >= p.host
                and b.i < coalesce((select min(e.i) from body e where e.doc_id = p.doc_id and e.i > p.host and not e.fenced), 1e18)) as stop from place p where r > 0),
parts as (select doc_id, cast(i as double) as a, 0 as b, 0 as c, 0::bigint as d, chunk from body
          union all select f.doc_id, case when e.host is null then 1e18 else e.stop end, 1, f.number, f.k, n.chunk
                    from figs f join ends e on e.doc_id = f.doc_id and e.number = f.number join n on n.doc_id = f.doc_id and n.i = f.chunk_at
          union all select distinct doc_id, 1e18, 0, 0, 0, '{P.ORPHAN_HEADING}' from ends where host is null),
made as (select doc_id, string_agg(trim(chunk, chr(10)), chr(10) || chr(10) order by a, b, c, d) || chr(10) as t from parts where {_STRIP("chunk")} <> '' group by doc_id),
said_of as (select e.doc_id, count(*) as figures, count(e.host) as placed,
                   string_agg(e.number || ': ' || coalesce(substr(trim(regexp_replace(b.bare, '{_WHITE}+', ' ', 'g')), 1, {P.AFTER_CHARS}), '-'), '; ' order by e.number) as report
            from ends e left join body b on b.doc_id = e.doc_id and b.i = e.host group by e.doc_id),
both_ as (select texts.doc_id, text, coalesce(t, chr(10)) as t, len(regexp_extract_all(text, '(?m)^!\[')) = len(regexp_extract_all(coalesce(t, ''), '(?m)^!\[')) as same from texts left join made on made.doc_id = texts.doc_id)
select b.doc_id, cast(length(case when same then t else text end) as int) as chars, md5(case when same then t else text end) as digest, cast(coalesce(figures, 0) as int) as figures, cast(coalesce(placed, 0) as int) as placed,
       coalesce(report, '') as report, case when same then 0 else 3 end as status
from both_ b left join said_of o on o.doc_id = b.doc_id
"""

NAVIGATION = rf"""
with h as (select page_id, {X.NAVIGATION} as html from pages),
n as (select *, regexp_extract(html, '(?s)({P.TOC_NAV})', 1) as nav, position('<nav id="TOC"' in html) as start from h),
r as (select *, substr(html, 1, start - 1) || substr(html, start + length(nav)) as rest,
             regexp_replace(regexp_replace(nav, '{P.re2("TOC_FIGURE_ENTRY")}', '', 'g'), '<ul>\s*</ul>', '', 'g') as clean from n),
a as (select *, case when regexp_matches(rest, '<h2[ >]') then length(regexp_extract(rest, '(?s)^(.*?)<h2[ >]', 1)) when contains(rest, '</h1>') then position('</h1>' in rest) + 4 else start - 1 end as cut from r),
m as (select *, substr(rest, 1, cut) || clean || substr(rest, cut + 1) as made from a)
select page_id, cast(length(made) as int) as chars, md5(made) as digest, cast(position('<nav id="TOC"' in made) as int) as at,
       cast(len(regexp_extract_all(clean, '<li><a href="#')) as int) as kept, cast(len(regexp_extract_all(nav, '{P.re2("TOC_FIGURE_ENTRY")}')) as int) as dropped from m
"""

PANEL_SPLIT = f"""
with f as (select doc_id as fig_id, 2 + doc_id % 2 as cols, doc_id % 4 as mode, (doc_id // 4) % 4 as kind from documents),
g as (select *, 2 * cols as n, 40 * cols + 10 as w from f),
p as (select *, unnest(range(0, n)) as k from g),
q as (select *, 10 + 40 * (k % cols) as x, 10 + 40 * (k // cols) as y, chr(cast(97 + k as int)) as letter, 'r' || (1 + k // cols) || 'c' || (1 + k % cols) as cell from p),
wrong as (select fig_id, case when mode = 3 then string_agg('label ' || letter || ' is in crop ' || cell, '; ' order by letter)
                             when mode in (1, 2) and kind = 2 then 'crop a holds y above its label'
                             when mode = 1 and kind = 3 then 'the caption lists ' || (n + 1) || ' panels but ' || n || ' were cut' else '' end as problems
          from q group by fig_id, mode, kind, n)
select q.fig_id, case when mode = 3 then cell else letter end as panel, cast(greatest(0, x - {P.PANEL_PAD}) as int) as x0, cast(greatest(0, y - {P.PANEL_PAD}) as int) as y0,
       cast(least(w, x + 26 + {P.PANEL_PAD}) as int) as x1, cast(least(90, y + 28 + {P.PANEL_PAD}) as int) as y1,
       case mode when 0 then 'layout' when 3 then 'grid' else 'gutters' end as method, problems, 1.0::double as ink_kept, case when problems = '' then 0 else 3 end as status
from q join wrong on wrong.fig_id = q.fig_id
"""
