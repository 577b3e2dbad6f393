"""SQL for DuckDB that gives what the queries give, from the same tables and the same expressions."""

from __future__ import annotations

from folioscope.functions import patterns as P
from folioscope.plans import fixtures as X
from folioscope.plans import folds


def _lines(expression: str) -> str:
    return f"(select doc_id, pos, {expression} as line from {X.LINES})"


def _classified(expression: str) -> str:
    """Records with class, translate, section, figure and depth; images stand before each third line."""
    return f"""
  r as (select doc_id, pos * 2 + 1 as pos, 'text' as kind, line as text from {_lines(expression)}
        union all select doc_id, pos * 2, 'image', null from {X.LINES} where pos % 3 = 0),
  m as (select *, kind <> 'image' and regexp_matches(text, '{P.re2("SKIP_SECTION")}') as opens from r),
  c as (select *, case when kind <> 'image' and not opens then try_cast(nullif(regexp_extract(text, '{P.re2("CAPTION_START")}', 1), '') as int) end as caption,
               coalesce(max(opens::int) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) = 1 as before from m),
  k as (select *, before and kind <> 'image' and not opens and caption is null as latched from c),
  classified as materialized (
    select doc_id, pos, kind, text, caption as figure,
           case when kind = 'image' then 'image' when opens then 'heading' when caption is not null then 'caption' when latched then 'text'
                when length(text) <= {P.GUESS_LENGTH} and not regexp_matches(text, '[.。;]$') then 'heading' else 'text' end as class,
           case when kind <> 'image' then not (opens or latched) end as translate,
           case when opens or latched then 'skip' end as section from k)"""


_CENSUS = f"""
  whole as (select doc_id, string_agg(text, ' ' order by pos) as t from classified where text is not null group by doc_id),
  mention as (select distinct doc_id, try_cast(n as int) as n
              from (select doc_id, unnest(regexp_extract_all(t, '{P.re2("REFERENCE")}', 1)) as p, unnest(regexp_extract_all(t, '{P.re2("REFERENCE")}', 2)) as n from whole)
              where trim(coalesce(p, '')) = '' and try_cast(n as int) between 1 and {P.LARGEST_NUMBER}),
  caps as (select doc_id, list_sort(list(distinct figure)) as captions from classified where class = 'caption' group by doc_id),
  refs as (select doc_id, list_sort(list(n)) as referenced from mention group by doc_id),
  census as (select d.doc_id, coalesce(captions, []) as captions, coalesce(referenced, []) as referenced
             from (select distinct doc_id from classified) d left join caps using (doc_id) left join refs using (doc_id))"""

_SIZES = f"(select doc_id, 'word/media/image' || pos || '.png' as media, {X.WIDTH} as width, {X.HEIGHT} as height, pos * 2 as pos from {X.LINES} where pos % 3 = 0)"

_FLOOR = f"""
  floors as (select doc_id, greatest({P.FURNITURE_FLOOR}, cast(floor({P.FURNITURE_SHARE} * percentile_disc(0.5) within group (order by side desc)) as bigint)) as floor
             from (select doc_id, media, max(greatest(width, height)) as side from {_SIZES} group by all) where side > 0 group by doc_id)"""

_IMAGES = f"""
  sized as (select s.doc_id, s.pos, s.media, greatest(s.width, s.height) < f.floor as furniture from {_SIZES} s join floors f using (doc_id)),
  placed as (select *, row_number() over (partition by doc_id, furniture order by pos) as place, count(*) filter (where not furniture) over (partition by doc_id) as many from sized),
  images as (select placed.doc_id, pos, media, furniture,
                    case when not furniture then (case when len(captions) = many then captions when len(referenced) = many then referenced else captions end)[place] end as figure
             from placed join census using (doc_id))"""

_RECORDS = f"with {_classified(X.MENTIONS)},{_CENSUS},{_FLOOR},{_IMAGES}"

_FILES = """n as (select *, 'media/' || case when furniture then 'logo' || lpad(seq::varchar, cast(greatest(2, length(seq::varchar)) as int), '0') when figure is not null then 'fig' || lpad(figure::varchar, 2, '0')
       else 'img' || lpad(seq::varchar, cast(greatest(2, length(seq::varchar)) as int), '0') end || '.png' as file
       from (select *, row_number() over (partition by doc_id order by pos) as seq from images))"""

_FENCED = f"""
  l as (select *, regexp_matches(line, '{P.re2("FENCE_LINE")}') as fence from {_lines(X.MARKDOWN)}),
  fenced as (select *, coalesce(sum(fence::int) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as inside from l)"""

_HEADINGS = rf"""{_FENCED},
  h as (select doc_id, pos, length(regexp_extract(line, '{P.re2("ATX_HEADING")}', 1)) as level, trim(regexp_extract(line, '{P.re2("ATX_HEADING")}', 2)) as title
        from fenced where not fence and not inside and regexp_matches(line, '{P.re2("ATX_HEADING")}')),
  b as (select *, trim(regexp_replace(regexp_replace(trim(lower(regexp_replace(regexp_replace(regexp_replace(title, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*_`~]+', '', 'g'))), '[^\pL\pN\pM\pZ\pC\s-]', '', 'g'), '\s+', '-', 'g'), '-') as base from h),
  headings as (select doc_id, pos, cast(level as int) as level, title, base || case when row_number() over w > 1 then '-' || (row_number() over w - 1) else '' end as anchor
               from b window w as (partition by doc_id, base order by pos))"""

_TOC = f"""with {_HEADINGS},
  entries as (select *, level - min(level) over (partition by doc_id) as indent from headings
              where level between 2 and @DEPTH@ and title <> '{P.TOC_TITLE}' and not regexp_matches(title, '{P.re2("FIGURE_HEADING")}'))"""

_PAGES = f"(select doc_id, cast(pos + 1 as int) as page, cast(length(line) as int) as chars, {X.RATIO} as img_ratio, {X.OPS} as draw_ops, cast(400 + (doc_id * 3 + pos) % 300 as double) as width from {X.LINES})"

_RULES = f"""
  p as (select *, chars < {P.MIN_TEXT_CHARS} and (img_ratio > {P.ANY_IMAGE} or draw_ops >= {P.BLANK_OPS}) as alone, img_ratio >= {P.IMAGE_SHARE} as raster, draw_ops >= {P.VECTOR_OPS} as vector from {_PAGES}),
  rules as (select *, alone or raster or vector as has_figure from p)"""

_CHUNKED = f"(select doc_id, string_agg(line, chr(10) || chr(10) order by pos) as text from {_lines(X.CHUNKS)} group by doc_id)"

_CHUNKS = rf"""
  s as (select doc_id, regexp_split_to_array(text, '\n\s*\n') as a from {_CHUNKED}),
  chunks as (select doc_id, cast(i - 1 as int) as pos, a[i] as chunk from (select doc_id, a, unnest(range(1, len(a) + 1)) as i from s))"""

_CELLS = "(select fig_id, rows, cols, unnest(range(0, rows * cols)) as k from (select doc_id as fig_id, 2 + doc_id % 2 as rows, 2 + doc_id % 3 as cols from documents))"
_BOX = lambda exprs: ", ".join(f"cast({e} as int) as {c}" for c, e in exprs.items())
_CHAR = lambda e: e.replace("char(", "chr(").replace("chr(97 + k)", "chr(cast(97 + k as int))")

_LABELS = f"""
  crops as (select fig_id, k as ord, chr(cast(97 + k as int)) as name, {_BOX(X.CROP)} from {_CELLS}),
  texts as (select fig_id, {_CHAR(X.LABEL)} as text, {_BOX(X.LABEL_BOX)} from {_CELLS}),
  read as (select *, case when regexp_matches(text, '{P.PANEL_LABEL}') then lower(regexp_extract(text, '{P.PANEL_LABEL}', 1)) || regexp_extract(text, '{P.PANEL_LABEL}', 2) end as label,
                  contains(text, '(') as bracket, median(y1 - y0) over (partition by fig_id) * {P.LABEL_HEIGHT} as least from texts),
  marked as (select *, max(bracket::int) over (partition by fig_id) as any_bracket from read where label is not null),
  firsts as (select *, row_number() over (partition by fig_id, label order by y0, x0, text) as rn from marked where (bracket or any_bracket = 0) and y1 - y0 >= least),
  family as (select *, sum(case when length(label) > 1 then 1 else 0 end) over (partition by fig_id, substr(label, 1, 1)) as kin from firsts where rn = 1),
  labels as (select fig_id, label, x0, y0, x1, y1 from family where length(label) = 1 or bracket or kin >= 2),
  pairs as (select l.fig_id, l.label, c.name, c.ord from labels l left join crops c on c.fig_id = l.fig_id
            and c.x0 <= (l.x0 + l.x1) / 2 and (l.x0 + l.x1) / 2 < c.x1 and c.y0 <= (l.y0 + l.y1) / 2 and (l.y0 + l.y1) / 2 < c.y1)"""

_SPREAD = """case when len(t) = 2 and regexp_matches(part, '[-–]') and length(t[1]) = 2 and length(t[2]) = 2 and t[1][1] = t[2][1] then [t[1][1] || i for i in range(cast(t[1][2] as int), cast(t[2][2] as int) + 1)]
       when len(t) = 2 and regexp_matches(part, '[-–]') and length(t[1]) = 1 and length(t[2]) = 1 then [chr(cast(i as int)) for i in range(ascii(t[1]), ascii(t[2]) + 1)] else t end"""

SQL: dict[str, str] = {
    "figure_census": f"""with {_classified(X.MENTIONS)},{_CENSUS},
  x as (select *, list_filter(referenced, lambda n: not list_contains(captions, n)) as missing from census)
select doc_id, array_to_string(captions, ',') as captions, array_to_string(referenced, ',') as referenced, array_to_string(missing, ',') as missing,
       case when len(captions) = 0 or len(missing) > 0 then 3 else 0 end as status from x""",
    "figure_consistency": f"""with {_classified(X.MENTIONS)},{_CENSUS},{_RULES},
  shown as (select doc_id, count(*) filter (where has_figure) as rendered from rules group by doc_id),
  x as (select doc_id, coalesce(list_max(case when len(captions) > 0 then captions else referenced end), 0) as expected from census)
select doc_id, expected, coalesce(rendered, 0) as rendered, expected = 0 or coalesce(rendered, 0) >= expected as consistent,
       case when expected = 0 or coalesce(rendered, 0) >= expected then 0 else 3 end as status from x left join shown using (doc_id)""",
    "caption_first_per_number": f"""with l as (select *, cast(floor(pos / 3) as int) as block from {_lines(X.MENTIONS)}),
  m as (select *, try_cast(nullif(regexp_extract(line, '{P.re2("CAPTION_START")}', 1), '') as int) as num, regexp_matches(line, '{P.re2("SUPPLEMENT_LINE")}') as other from l),
  f as (select doc_id, block, min(pos) as at, arg_min(num, pos) as num from m where num is not null and not other group by all),
  t as (select f.doc_id, f.block, f.num, trim(regexp_replace(string_agg(l.line, ' ' order by l.pos), '\\s+', ' ', 'g')) as text
        from f join l on l.doc_id = f.doc_id and l.block = f.block and l.pos >= f.at group by all),
  p as (select doc_id, num, cast(1 + floor(block / 4) as int) as page, cast((block * 7) % 11 as double) as y0, block, text from t)
select doc_id, num, page, y0, substr(text, 1, {P.CAPTION_CHARS}) as text from p
qualify row_number() over (partition by doc_id, num order by page, y0, block) = 1""",
    "section_skip_latch": f"with {_classified(X.SECTIONS)} select doc_id, cast(pos as int) as pos, class, translate, section, figure from classified where kind <> 'image'",
    "heading_guess": f"select doc_id, cast(pos as int) as pos, line from {X.LINES} where length(line) <= {P.GUESS_LENGTH} and not regexp_matches(line, '[.。;]$')",
    "doc_manifest": f"""{_RECORDS},
  counts as (select doc_id, count(*) as records, count(*) filter (where kind = 'image') as images, count(*) filter (where class in ('text', 'heading') and translate) as paragraphs,
                    cast(coalesce(sum(length(text)) filter (where class in ('text', 'heading') and translate), 0) as bigint) as chars, count(*) filter (where not translate) as skipped
             from classified group by doc_id),
  shown as (select doc_id, list_sort(list(distinct figure)) as numbered from images where figure is not null group by doc_id),
  x as (select counts.*, captions, referenced, coalesce(numbered, []) as numbered from counts join census using (doc_id) left join shown using (doc_id))
select doc_id, records, images, array_to_string(numbered, ',') as numbered, array_to_string(captions, ',') as captions, array_to_string(referenced, ',') as referenced, paragraphs, chars, skipped,
       concat_ws('; ', case when len(captions) = 0 then 'no caption was found' end,
                 case when len(list_filter(captions, lambda n: not list_contains(numbered, n))) > 0 then 'captions name [' || array_to_string(captions, ', ') || '] but images are numbered [' || array_to_string(numbered, ', ') || ']' end,
                 case when len(list_filter(referenced, lambda n: not list_contains(captions, n))) > 0 then 'the text refers to [' || array_to_string(list_filter(referenced, lambda n: not list_contains(captions, n)), ', ') || '] without a caption' end) as problems,
       case when len(captions) = 0 or len(list_filter(captions, lambda n: not list_contains(numbered, n))) > 0 or len(list_filter(referenced, lambda n: not list_contains(captions, n))) > 0 then 3 else 0 end as status from x""",
    "figure_numbering_zip": f"{_RECORDS} select doc_id, cast(pos as int) as pos, furniture, figure from images",
    "furniture_upper_median": f"with {_FLOOR} select doc_id, floor from floors",
    "media_first_seen_names": f"""{_RECORDS}, n as (select *, row_number() over (partition by doc_id order by pos) as seq from images)
select doc_id, cast(pos as int) as pos, media, 'media/' || case when furniture then 'logo' || lpad(seq::varchar, cast(greatest(2, length(seq::varchar)) as int), '0') when figure is not null then 'fig' || lpad(figure::varchar, 2, '0')
       else 'img' || lpad(seq::varchar, cast(greatest(2, length(seq::varchar)) as int), '0') end || '.png' as file from n""",
    "rendered_markdown": f"""with {_classified(X.SECTIONS)},
  shown as (select doc_id, pos, case class when 'caption' then '**CAPTION Fig ' || figure || '** ' || text
               when 'heading' then '## ' || text || case when translate then '' else '{P.UNTRANSLATED}' end else text || case when translate then '' else '{P.UNTRANSLATED}' end end as line
        from classified where kind <> 'image'),
  made as (select doc_id, string_agg(line, chr(10) || chr(10) order by pos) || chr(10) as t from shown group by doc_id)
select doc_id, cast(length(t) as int) as chars, md5(t) as digest from made""",
    "page_figure_rules": f"""with {_RULES}
select doc_id, page, chars, round(img_ratio, 3) as img_ratio, draw_ops, has_figure,
       concat_ws('; ', case when alone then 'standalone figure page' end, case when raster then 'raster image ' || cast(round_even(img_ratio * 100, 0) as int) || '% of page' end,
                 case when vector then 'vector drawing (' || draw_ops || ' ops)' end) as why from rules""",
    "scanned_documents": f"""select doc_id, count(*) as pages, cast(sum(chars) as bigint) as chars, max(chars) < {P.MIN_TEXT_CHARS} as scanned, sum(chars) < {P.OCR_CHARS_A_PAGE} * count(*) as poor
from {_PAGES} group by doc_id""",
    "render_zoom": f"with {_RULES} select doc_id, page, least({P.RENDER_DPI} / 72.0::double, {P.RENDER_WIDTH}::double / width) as zoom from rules where has_figure",
    "panel_letters": f"""with g as (select doc_id, unnest(regexp_extract_all({X.PANELS}, '{P.PANEL_GROUP}', 1)) as g from documents),
  parts as (select doc_id, unnest(regexp_split_to_array(g, '\\s*(?:,|and|&)\\s*')) as part from g),
  t as (select doc_id, part, regexp_extract_all(part, '[a-z]\\d?') as t from parts),
  n as (select distinct doc_id, unnest({_SPREAD}) as name from t),
  plain as (select doc_id, name, row_number() over (partition by doc_id order by name) - 1 as i from n where length(name) = 1),
  run as (select doc_id, list(name order by name) as run from plain where ascii(name) - 97 = i group by doc_id),
  idx as (select doc_id, list(name order by name) as idx from n where length(name) = 2 group by doc_id),
  bare as (select doc_id, unnest(regexp_extract_all({X.PANELS}, '(?:^|[^A-Za-z])([a-z])\\s+[A-Z]', 1)) as name from documents
           union select doc_id, chr(cast(unnest(range(ascii(a), ascii(b) + 1)) as int))
           from (select doc_id, regexp_extract({X.PANELS}, '(?:^|[^A-Za-z])([a-z])\\s*[-–]\\s*([a-z])\\s+[A-Z]', 1) as a, regexp_extract({X.PANELS}, '(?:^|[^A-Za-z])([a-z])\\s*[-–]\\s*([a-z])\\s+[A-Z]', 2) as b from documents) where a <> ''),
  bares as (select doc_id, list(name order by name) as bare from (select *, row_number() over (partition by doc_id order by name) - 1 as i from bare) where ascii(name) - 97 = i group by doc_id),
  x as (select d.doc_id, coalesce(run, []) as run, coalesce(idx, []) as idx, coalesce(bare, []) as bare from documents d left join run on run.doc_id = d.doc_id left join idx on idx.doc_id = d.doc_id left join bares on bares.doc_id = d.doc_id)
select doc_id, case when len(run) >= 2 then array_to_string(run, ',') when len(idx) >= 2 and idx[1] = 'a1' then array_to_string(idx, ',') when len(bare) >= 3 then array_to_string(bare, ',') else '' end as panels,
       case when len(run) >= 2 or (len(idx) >= 2 and idx[1] = 'a1') then 'parenthesised' when len(bare) >= 3 then 'bare' else 'none' end as panels_from from x""",
    "page_ranges": """select doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_concat([1 + doc_id % 9, 7], range(2 + doc_id % 5, 2 + doc_id % 11)), lambda p: p between 1 and 8))), ','), '') as pages from documents""",
    "fence_parity": f"with {_FENCED} select doc_id, cast(pos as int) as pos, fence, inside from fenced",
    "heading_slugs": f"with {_HEADINGS} select doc_id, cast(pos as int) as pos, level, title, anchor from headings",
    "toc_entries": _TOC.replace("@DEPTH@", "4") + " select doc_id, cast(pos as int) as pos, level, title, anchor, indent from entries",
    "toc_strip": f"""with l as (select *, min(pos) filter (where line = '{P.TOC_BEGIN}') over (partition by doc_id) as b from {_lines(X.TOC)}),
  m as (select *, min(pos) filter (where line = '{P.TOC_END}' and pos >= b) over (partition by doc_id) as e from l)
select doc_id, cast(pos as int) as pos, line from m where not coalesce(e is not null and (pos between b and e or (pos = e + 1 and trim(line) = '')), false)""",
    "toc_insert": _TOC.replace("@DEPTH@", "3") + f""",
  block as (select doc_id, '{P.TOC_BEGIN}' || chr(10) || '## {P.TOC_TITLE}' || chr(10) || chr(10) || string_agg(repeat('  ', indent) || '- [' || title || '](#' || anchor || ')', chr(10) order by pos) || chr(10) || chr(10) || '{P.TOC_END}' as block from entries group by doc_id),
  place as (select doc_id, min(pos) as at from headings where level >= 2 group by doc_id),
  x as (select l.doc_id, l.pos, case when l.pos = place.at and block is not null then block || chr(10) || chr(10) || l.line else l.line end as line from l left join block using (doc_id) left join place using (doc_id)),
  m as (select doc_id, rtrim(string_agg(line, chr(10) order by pos), chr(10)) || chr(10) as t from x group by doc_id)
select doc_id, cast(length(t) as int) as chars, md5(t) as digest from m""",
    "chunk_split": f"with {_CHUNKS} select doc_id, pos, chunk from chunks",
    "figure_chunk_number": f"""with {_CHUNKS},
  i as (select doc_id, pos, regexp_extract(trim(chunk), '{P.re2("IMAGE_CHUNK")}', 1) as alt, regexp_extract(trim(chunk), '{P.re2("IMAGE_CHUNK")}', 2) as path from chunks where regexp_matches(trim(chunk), '{P.re2("IMAGE_CHUNK")}')),
  n as (select doc_id, pos, coalesce(try_cast(nullif(regexp_extract(alt, '{P.re2("FIGURE_IN_CAPTION")}', 1), '') as int), try_cast(nullif(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '{P.re2("FIGURE_IN_PATH")}', 1), '') as int)) as figure from i)
select * from n where figure is not null""",
    "image_conservation": f"select doc_id, cast(len(regexp_extract_all(text, '(?m)^!\\[')) as int) as images from {_CHUNKED}",
    "panel_labels": f"with {_LABELS} select * from labels",
    "label_in_box": f"""with {_LABELS}, c as (select *, count(name) over (partition by fig_id, name) as crowd from pairs)
select fig_id, label, name as crop, case when name is not null then crowd else 0 end as crowd from c qualify row_number() over (partition by fig_id, label order by ord nulls last, name) = 1""",
    "panel_furniture": f"""with {_LABELS}, kept as (select * from labels where y0 > 60), tops as (select fig_id, min(y0) as top from kept group by fig_id)
select c.fig_id, c.name, coalesce(c.y1 <= top and not exists (select 1 from kept l where l.fig_id = c.fig_id and c.x0 <= (l.x0 + l.x1) / 2 and (l.x0 + l.x1) / 2 < c.x1 and c.y0 <= (l.y0 + l.y1) / 2 and (l.y0 + l.y1) / 2 < c.y1), false) as furniture
from crops c left join tops on tops.fig_id = c.fig_id""",
    "segmentation_score": f"""with {_LABELS},
  hit as (select fig_id, label, arg_min(name, ord) filter (where name is not null) as name from pairs group by all),
  votes as (select fig_id, count(*) filter (where name = label) as agree, count(*) as total from hit group by fig_id),
  crowd as (select fig_id, count(*) as crowded from (select fig_id, name from pairs where name is not null group by all having count(*) > 1) group by fig_id),
  x as (select f.fig_id, coalesce(agree, 0) as agree, coalesce(total, 0) as total, coalesce(crowded, 0) as crowded from (select distinct fig_id from crops) f left join votes using (fig_id) left join crowd using (fig_id))
select fig_id, agree, total - agree as disagree, crowded, 3 * agree - 2 * total - 3 * crowded as score from x""",
    "best_gutter": f"""with t as (select doc_id as fig_id, ord, [{", ".join(map(str, P.GUTTERS))}]::double[] as g, cast((doc_id * 7 + ord * 5) % 9 - 3 as int) as score, cast(2 + (doc_id + ord) % 4 as int) as panels from documents, range(0, {len(P.GUTTERS)}) r(ord))
select fig_id, g[ord + 1] as gutter, score, panels, panels = 2 + fig_id % 4 as hit from t
qualify row_number() over (partition by fig_id order by (panels = 2 + fig_id % 4)::int desc, score desc, panels desc, ord) = 1""",
    "capability_verdict": f"""with p as (select cast(c_custkey as varchar) as machine, key, {X.PROBE} as ok from (select c_custkey, k, ['pymupdf', 'lxml', 'imaging', 'converter', 'ocr', 'vision', 'pandoc', 'browser'][k + 1] as key from customer, range(0, 8) r(k))),
  w as (select machine, bool_or(ok and key = 'pymupdf') as pymupdf, bool_or(ok and key = 'lxml') as lxml, bool_or(ok and key = 'imaging') as imaging, bool_or(ok and key = 'converter') as converter, bool_or(ok and key = 'ocr') as ocr, bool_or(ok and key = 'vision') as vision from p group by machine),
  u as (select *, concat_ws(',', case when converter and lxml then 'converter' end, case when ocr then 'ocr' end, case when vision then 'vision' end) as usable from w),
  c as (select *, case when not pymupdf then 1 when usable <> '' then 0 else 4 end as code from u)
select machine, usable, code, case when code = 0 then (converter and not lxml)::int + (not imaging or not ocr)::int + (not (ocr or vision))::int + (not converter)::int + (not vision)::int else 0 end as limits from c""",
    "html_heading_census": "select page_id, len(regexp_extract_all(html, '<h1[ >]')) as titles, len(regexp_extract_all(html, '<nav[ >]')) as navs, len(regexp_extract_all(html, '<li[ >]')) as items from pages",
    "stitched_text": f"""select doc_id, cast(pos as int) as pos, trim(regexp_replace(regexp_replace(replace(line, chr(173), ''), '(\\w)-\\s+([a-z])', '\\1\\2', 'g'), '\\s+', ' ', 'g')) as text from {_lines(X.BREAKS)}""",
    "style_levels": f"""with s as (select doc_id, pos, {X.STYLE} as style, {X.OUTLINE} as outline from {X.LINES})
select doc_id, cast(pos as int) as pos, case when regexp_matches(coalesce(style, ''), '{P.HEADING_STYLE}') then cast(regexp_extract(style, '{P.HEADING_STYLE}', 1) as int)
       when lower(style) in ('title', 'subtitle') then 1 when try_cast(outline as int) is not null then least(9, try_cast(outline as int) + 1) else 0 end as level from s""",
    "panel_specs": f"""with s as (select doc_id, trim({X.GRID}) as g, trim({X.LAYOUT}) as l, trim({X.EXPECT.replace("char(", "chr(")}) as e from documents),
  n as (select *, regexp_extract(g, '^(\\d+)\\s*[xX*]\\s*(\\d+)$', 1) as r, regexp_extract(g, '^(\\d+)\\s*[xX*]\\s*(\\d+)$', 2) as c, list_filter(regexp_split_to_array(l, '[,+\\s]+'), lambda p: p <> '') as parts from s),
  p as (select doc_id, unnest(list_filter(regexp_split_to_array(e, '[,\\s+]+'), lambda p: p <> '')) as part from s),
  names as (select doc_id, unnest(case when regexp_matches(part, '(?i)^([a-z])-([a-z])$') then [chr(cast(i as int)) for i in range(ascii(lower(part[1])), ascii(lower(part[3])) + 1)] else [lower(part)] end) as name from p),
  x as (select doc_id, string_agg(distinct name, ',' order by name) as expect from names group by doc_id)
select n.doc_id, try_cast(nullif(r, '') as int) as rows, try_cast(nullif(c, '') as int) as cols,
       case when len(parts) > 0 and len(list_filter(parts, lambda p: coalesce(try_cast(p as int), 0) < 1)) = 0 then array_to_string(parts, ',') end as layout, coalesce(expect, '') as expect
from n left join x using (doc_id)""",
    "page_text": f"""with p as (select doc_id, pos, case when pos % 5 = 2 then '' else line end as t from {X.LINES}),
  m as (select doc_id, string_agg(chr(10) || '===== PAGE ' || (pos + 1) || ' =====' || chr(10) || chr(10) || case when t = '' then '[no text layer]' else t end || chr(10), '' order by pos) as t from p group by doc_id)
select doc_id, cast(length(t) as int) as chars, md5(t) as digest from m""",
    "label_problems": f"""with {_LABELS}, c as (select *, count(name) over (partition by fig_id, name) as crowd from pairs),
  h as (select fig_id, label, name, case when name is not null then crowd else 0 end as crowd from c qualify row_number() over (partition by fig_id, label order by ord nulls last, name) = 1),
  w as (select distinct fig_id, unnest([case when name is null then 'label ' || label || ' is outside every crop' when name <> label then 'label ' || label || ' is in crop ' || name end,
                                        case when crowd > 1 then 'crop ' || name || ' holds several labels' end]) as problem from h),
  g as (select fig_id, string_agg(problem, '; ' order by problem) as problems from w where problem is not null group by fig_id)
select f.fig_id, coalesce(problems, '') as problems, case when problems is null then 0 else 3 end as status from (select distinct fig_id from labels) f left join g using (fig_id)""",
    "texts_in_crops": f"""with {_LABELS} select c.fig_id, c.name, t.text from crops c join texts t on t.fig_id = c.fig_id and t.x0 >= c.x0 - 2 and t.y0 >= c.y0 - 2 and t.x1 <= c.x1 + 2 and t.y1 <= c.y1 + 2""",
    "capability_report": f"""with p as (select cast(c_custkey as varchar) as machine, k, key, {X.PROBE} as ok from (select c_custkey, k, ['pymupdf', 'lxml', 'imaging', 'converter', 'ocr', 'vision', 'pandoc', 'browser'][k + 1] as key from customer, range(0, 8) r(k))),
  m as (select machine, string_agg(case when ok then '  ok  ' else '  NO  ' end || rpad(key, 22, ' ') || ' d' || case when ok then '' else chr(10) || '      -> f' end, chr(10) order by k) as t from p group by machine)
select machine, cast(length(t) as int) as chars, md5(t) as digest from m""",
    "rendered_markdown_figures": f"""{_RECORDS}, {_FILES},
  shown as (select c.doc_id, c.pos, case c.class when 'caption' then '**CAPTION Fig ' || c.figure || '** ' || text
               when 'image' then case when not n.furniture then '[[FIG ' || coalesce(n.figure::varchar, '?') || ' -> ' || n.file || ']]' end
               when 'heading' then '## ' || text || case when translate then '' else '{P.UNTRANSLATED}' end else text || case when translate then '' else '{P.UNTRANSLATED}' end end as line
        from classified c left join n on n.doc_id = c.doc_id and n.pos = c.pos),
  made as (select doc_id, coalesce(string_agg(line, chr(10) || chr(10) order by pos), '') || chr(10) as t from shown group by doc_id)
select doc_id, cast(length(t) as int) as chars, md5(t) as digest from made""",
    "readable_media_names": f"""{_RECORDS}, {_FILES}
select doc_id, cast(pos as int) as pos, media, case when (doc_id + pos) % 5 <> 1 then file end as file from n""",
    "caption_census": f"""with w as (select doc_id, string_agg(line, chr(10) order by pos) as t from {_lines(X.BARS)} group by doc_id),
  m as (select distinct doc_id, try_cast(n as int) as n from (select doc_id, unnest(regexp_extract_all(t, '{P.re2("CAPTION_BAR")}', 1)) as p, unnest(regexp_extract_all(t, '{P.re2("CAPTION_BAR")}', 2)) as n from w)
        where trim(coalesce(p, '')) = '' and try_cast(n as int) between 1 and {P.LARGEST_NUMBER})
select w.doc_id, coalesce(string_agg(n::varchar, ',' order by n), '') as figures from w left join m on m.doc_id = w.doc_id group by w.doc_id""",
    "line_offsets": f"""with t as (select doc_id, translate(text, chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(133) || chr(8232) || chr(8233), '') as text from documents),
  l as (select doc_id, unnest(range(0, len(a))) as pos, unnest(a) as line, len(a) as many from (select doc_id, string_split(text, chr(10)) as a from t)),
  k as (select * from l where not (pos = many - 1 and line = ''))
select doc_id, cast(pos as int) as pos, cast(coalesce(sum(length(line) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as int) as offset, cast(length(line) as int) as chars from k""",
    "forced_pages": f"""with w as (select doc_id, unnest(list_distinct(list_filter(list_concat([1 + doc_id % 9, 7], range(2 + doc_id % 5, 2 + doc_id % 11)), lambda p: p between 1 and 8))) as page from documents)
select p.doc_id, p.page, least({P.RENDER_DPI} / 72.0::double, {P.RENDER_WIDTH}::double / width) as zoom from {_PAGES} p join w on w.doc_id = p.doc_id and w.page = p.page""",
    "strip_toc_blocks": f"""with t as (select doc_id, string_agg(line, chr(10) order by pos) as t from {_lines(X.TOC)} group by doc_id),
  m as (select doc_id, regexp_replace(t, '(?sm){P.TOC_BLOCK}', '', 'g') as t, regexp_matches(t, '(?sm){P.TOC_BLOCK}') as had from t)
select doc_id, cast(length(t) as int) as chars, md5(t) as digest, had from m""",
    "recognised_texts": f"select fig_id, {_CHAR(X.LABEL)} as text, {_BOX(X.LABEL_BOX)} from {_CELLS}",
    "capability_limits": f"""with p as (select cast(c_custkey as varchar) as machine, key, {X.PROBE} as ok from (select c_custkey, k, ['pymupdf', 'lxml', 'imaging', 'converter', 'ocr', 'vision', 'pandoc', 'browser'][k + 1] as key from customer, range(0, 8) r(k))),
  w as (select machine, bool_or(ok and key = 'pymupdf') as pymupdf, bool_or(ok and key = 'lxml') as lxml, bool_or(ok and key = 'imaging') as imaging, bool_or(ok and key = 'converter') as converter, bool_or(ok and key = 'ocr') as ocr, bool_or(ok and key = 'vision') as vision from p group by machine)
select machine, case when pymupdf and ((converter and lxml) or ocr or vision) then concat_ws('; ',
         case when converter and not lxml then 'converter: unusable without its reader' end,
         case when not imaging then 'panels: cannot be split' when not (ocr or vision) then 'panels: geometry only' when not ocr then 'panels: no label check' end,
         case when not (ocr or vision) then 'scanned: cannot be read' end, case when not converter then 'figures: positions are guessed' end,
         case when not vision then 'captions: pairing is not checked by eye' end) else '' end as limits from w""",
    "capability_probes": """with b as (select c_custkey, list_filter(['a', 'b', 'c'], lambda m, i: (c_custkey + i - 1) % 3 <> 0) as there, list_filter(['one', 'two'], lambda m, i: (c_custkey >> cast(i - 1 as int)) % 2 = 1) as engines from customer),
  m as (select *, list_filter(['a', 'b'], lambda x: not list_contains(there, x)) as missing from b)
select cast(c_custkey as varchar) as machine, len(missing) = 0 as modules_ok, array_to_string(missing, ',') as missing,
       c_custkey % 5 <> 0 and c_custkey % 7 <> 0 and len(engines) > 0 as converter_ok,
       case when c_custkey % 5 = 0 then 'not Windows' when c_custkey % 7 = 0 then 'bridge missing' when len(engines) = 0 then 'no engine' else array_to_string(engines, ' + ') end as detail,
       engines[1] as engine, '/' || chr(cast(65 + c_custkey % 26 as int)) || '/a/' || c_custkey as device from m""",
    "word_records": f"""with l as (select doc_id, pos, regexp_replace(line, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') || case when pos % 4 = 1 then ' coda' else '' end as line from {X.LINES}),
  t as (select *, trim(regexp_replace(regexp_replace(replace(line, chr(173), ''), '(\\w)-\\s+([a-z])', '\\1\\2', 'g'), '[\\s\\p{{Z}}\\x{{85}}]+', ' ', 'g')) as text, case when pos % 5 = 0 and pos % 6 <> 5 then 1 + pos % 3 else 0 end as level from l),
  r as (select doc_id, pos * 2 + 1 as ord, case when level > 0 then 'heading' else 'text' end as kind, text, level, null as media from t where text <> ''
        union all select doc_id, pos * 2, 'image', null, 0, 'word/media/image' || (pos % 3) || '.png' from t where pos % 4 = 3 qualify row_number() over (partition by doc_id, pos % 3 order by pos) = 1)
select cast(doc_id as varchar) as doc_id, cast(row_number() over (partition by doc_id order by ord) - 1 as int) as pos, kind, text, cast(level as int) as level, media, null::varchar as error from r""",
    "relocate_figures": folds.RELOCATE,
    "pair_captions": folds.PAIR_CAPTIONS,
    "figure_regions": folds.FIGURE_REGIONS,
    "panel_split": folds.PANEL_SPLIT,
    "reading_order": folds.READING_ORDER,
    "merge_to_count": folds.merge_to_count(_LABELS),
    "navigation_tidy": folds.NAVIGATION,
}
