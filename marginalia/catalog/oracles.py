"""The SQL counterpart of every query, for DuckDB over the same tables.

The SQL states the results directly (names are compared pair by pair, vectors are summed bucket by
bucket, cards are computed from the papers and not from the reports), so that it shares no method
with the Spark code.
"""

from __future__ import annotations

from marginalia.catalog.fixtures import MICRO_OFFSET
from marginalia.catalog.queries import (
    BAND_THRESHOLD,
    CATEGORIES,
    MODEL,
    PAIR_FLOOR,
    STOPWORDS,
    THRESHOLD,
)
from marginalia.functions.strings import WHITESPACE
from marginalia.operators.state import model_fingerprint
from marginalia.operators.vectors import HASH_DIM, MAX_TOKENS

NL = "chr(10)"
BLANK = f"'{WHITESPACE}'"
FINGERPRINT = model_fingerprint(MODEL)


def listed(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


def strip(x: str) -> str:
    return f"trim({x}, {BLANK})"


def line_field(label: str, text: str = "content") -> str:
    rest = f"substr({text}, instr({text}, '{label}') + {len(label)})"
    return f"CASE WHEN instr({text}, '{label}') > 0 THEN {strip(f'split_part({rest}, {NL}, 1)')} ELSE '' END"


def block_field(start: str, end: str, text: str = "content") -> str:
    rest = f"substr({text}, instr({text}, '{start}') + {len(start)})"
    cut = f"split_part({rest}, '{end}', 1)"
    return f"CASE WHEN instr({text}, '{start}') > 0 THEN {strip(cut)} ELSE '' END"


def words(text: str) -> str:
    return f"list_filter(string_split(translate({text}, {BLANK}, repeat(' ', {len(WHITESPACE)})), ' '), lambda w: w <> '')"


def micro(vec: str) -> str:
    return f"array_to_string(list_transform({vec}, lambda x: floor(x::DOUBLE * 1e6 + {MICRO_OFFSET}::DOUBLE)::BIGINT::VARCHAR), ' ')"


def bucket(word: str) -> str:
    return f"('0x' || substr(md5({word}), 1, 8))::UBIGINT % {HASH_DIM}"


PAPERS = f"""
split AS (
  SELECT *, list_filter(string_split(replace(text, {NL}, ' '), ' '), lambda w: w <> '') AS w FROM documents
),
papers AS (
  SELECT doc_id AS key, 'T' || doc_id || ' ' || split_part(text, {NL}, 1) AS title,
         list_filter([w[1] || ' ' || w[2], w[3] || ' ' || w[4], substr(w[5], 1, 1) || ' ' || w[6]], lambda a: a IS NOT NULL) AS authors,
         text AS abstract, 'http://h/pdf/' || doc_id || '.pdf' AS url,
         TIMESTAMP '2024-01-01' + to_minutes(37 * doc_id) AS published, source, lang
  FROM split
),
corpus AS (
  SELECT key, 'Title: ' || title || {NL} || 'Authors: ' || array_to_string(authors, ', ') || {NL} || 'Abstract:' || {NL}
         || abstract || {NL} || 'URL: ' || url || {NL} || 'Date: ' || strftime(published, '%Y-%m-%d') || {NL} AS content
  FROM papers
)"""

PARSED = f"""
parsed AS (
  SELECT key, {line_field("Title:")} AS title, {line_field("Authors:")} AS authors,
         {block_field("Abstract:", "URL:")} AS abstract, {line_field("URL:")} AS url, {line_field("Date:")} AS date
  FROM corpus
)"""

TEXTS = f"""
texts AS (
  SELECT key, {line_field("Title:")} || ' [SEP] ' || {block_field("Abstract:", "Date:")} AS text FROM corpus
)"""


def vectors_of(name: str, texts: str) -> str:
    """CTEs `{name}_tf` (key, bucket, tf), `{name}_norm` and `{name}` (key, vec) of a text table."""
    return f"""
{name}_words AS (SELECT key, unnest({words("lower(text)")}) AS word FROM {texts}),
{name}_tf AS (SELECT key, {bucket("word")} AS bucket, count(*)::DOUBLE AS tf FROM {name}_words GROUP BY ALL),
{name}_norm AS (SELECT key, sqrt(sum(tf * tf)) AS norm FROM {name}_tf GROUP BY key),
{name}_dims AS (
  SELECT k.key, d.bucket, coalesce(t.tf, 0) / greatest(coalesce(n.norm, 0), 1e-12) AS x
  FROM (SELECT key FROM {texts}) k CROSS JOIN (SELECT unnest(range({HASH_DIM})) AS bucket) d
  LEFT JOIN {name}_tf t ON t.key = k.key AND t.bucket = d.bucket LEFT JOIN {name}_norm n ON n.key = k.key
),
{name} AS (SELECT key, list(x ORDER BY bucket) AS vec FROM {name}_dims GROUP BY key)"""


AUTHORS = f"""
author_rows AS (
  SELECT key, unnest(names) AS author, generate_subscripts(names, 1) - 1 AS pos
  FROM (SELECT key, list_filter(list_transform(string_split(replace({line_field("Authors:")}, 'Authors:', ''), ','),
                                lambda a: {strip("a")}), lambda a: a <> '') AS names FROM corpus)
)"""


def parts(name: str) -> str:
    spaced = f"""translate(lower({name}), ',."''-_()', '        ')"""
    return words(spaced)


def first_last(source: str, name: str, columns: str) -> str:
    return f"""SELECT {columns}, coalesce(p[1], '') AS first, CASE WHEN len(p) > 1 THEN p[-1] ELSE '' END AS last
  FROM (SELECT *, {parts(name)} AS p FROM {source})"""


def names_of(label: str) -> str:
    return f"""
{label}_names AS (
  SELECT unnest(authors) AS name FROM papers WHERE key IN (SELECT doc_id FROM labels WHERE {label} = 1)
),
{label}_parts AS (SELECT DISTINCT first, last FROM ({first_last(f"{label}_names", "name", "name")}))"""


AUTHOR_PARTS = f"author_parts AS ({first_last('author_rows', 'author', 'key, pos, author')})"

INITIAL = "substr(a.first, 1, 1) = substr(n.first, 1, 1)"
STRICT = f"(a.first = n.first OR ({INITIAL} AND (length(a.first) = 1 OR length(n.first) = 1)))"
LOOSE = f"(a.first = n.first OR {INITIAL})"


def matches(label: str, rule: str) -> str:
    return f"EXISTS (SELECT 1 FROM {label}_parts n WHERE n.last <> '' AND a.last = n.last AND {rule})"


ROUTED = f"""
hits AS (
  SELECT key, bool_or({matches("toxic", STRICT)}) AS black, bool_or({matches("quality", STRICT)}) AS white
  FROM author_parts a GROUP BY key
),
flagged AS (SELECT c.key, coalesce(black, false) AS black, coalesce(white, false) AS white
            FROM corpus c LEFT JOIN hits USING (key)),
routed AS (SELECT key, CASE WHEN white THEN 'Priority' ELSE 'Other' END AS section FROM flagged WHERE NOT black)"""

ROUTING = ",".join([PAPERS, AUTHORS, AUTHOR_PARTS, names_of("toxic"), names_of("quality"), ROUTED])
MATCHING = ",".join([PAPERS, AUTHORS, AUTHOR_PARTS, names_of("quality")])

SIMS = """
sims AS (
  SELECT a.vec_id AS key, a.label, b.vec_id AS my_key,
         list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
  FROM embeddings a, embeddings b WHERE a.label <> 0 AND b.label = 0
),
scores AS (SELECT key, label, round(max(sim), 6) AS score FROM sims GROUP BY ALL)"""

TOKENS = f"""
token_rows AS (
  SELECT doc_id AS key, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos
  FROM (SELECT doc_id, list_filter(string_split(replace(text, {NL}, ' '), ' '), lambda w: w <> '') AS w FROM documents)
),
token_dims AS (
  SELECT key, pos, (length(word) > 2)::INT AS mask, d.dim,
         ascii(substr(md5(word), d.dim + 1, 1)) / 97.0::DOUBLE AS x
  FROM token_rows CROSS JOIN (SELECT unnest(range(8)) AS dim) d
)"""

SCORED = """
scored AS (
  SELECT key, strftime(published, '%Y-%m-%d') AS run_date, CASE WHEN lang = 'en' THEN 'Other' ELSE 'Priority' END AS section,
         ('0x' || substr(md5(abstract), 1, 8))::UBIGINT::DOUBLE / 4294967295.0::DOUBLE AS score
  FROM papers
),
best AS (SELECT *, row_number() OVER (PARTITION BY run_date, section ORDER BY score DESC, key) AS rank FROM scored)"""

ENTRY = f"""'### [' || title || '](' || url || ')' || {NL} || '**Authors:** ' || authors || {NL} || '**Date:** ' || date || {NL}
  || '**Similarity Score:** ' || printf('%.4f', score) || {NL} || '**Abstract:**' || {NL} || abstract"""

RECS = f"recs AS (SELECT * FROM best JOIN parsed USING (key)), entries AS (SELECT *, {ENTRY} AS entry FROM recs)"


def section_md(header: str, section: str) -> str:
    body = f"string_agg(entry || {NL} || {NL} || '---' || {NL} || {NL}, '' ORDER BY rank) FILTER (WHERE section = '{section}')"
    return f"""'## {header}' || {NL} || {NL} || '## Top Recommendations:' || {NL} || {NL} || {body} || {NL}"""


MD = f"""
md_parts AS (
  SELECT run_date, {section_md("Priority (whitelist authors)", "Priority")} AS priority_md,
         {section_md("Other recommendations", "Other")} AS other_md
  FROM entries GROUP BY run_date
),
reports AS (SELECT run_date, coalesce(priority_md, '') || coalesce(other_md, '') AS md,
                   priority_md IS NOT NULL AND other_md IS NOT NULL AS two_sections FROM md_parts)"""

REPORTS = ",".join([PAPERS, PARSED, SCORED, RECS, MD])

SHOWN = """
shown AS (
  SELECT run_date, CASE WHEN two_sections THEN section ELSE 'Other' END AS section, rank - 1 AS pos, entries.* EXCLUDE (run_date, section, rank)
  FROM entries JOIN reports USING (run_date)
)"""
HEADING = "'### [' || title || '](' || url || ')'"
LINK_TITLE = f"split_part(substr({HEADING}, instr({HEADING}, '[') + 1), ']', 1)"
LINK_URL = f"regexp_extract(substr({HEADING}, instr({HEADING}, '](') + 2), '(?s)^(.*)\\)', 1)"

DATE_LABEL = "strftime(run_date::DATE, '%B %-d, %Y')"
COUNTS = """
counts AS (
  SELECT run_date, CASE WHEN any_value(two_sections) THEN count(*) FILTER (WHERE section = 'Priority') ELSE 0 END AS priority_n,
         CASE WHEN any_value(two_sections) THEN count(*) FILTER (WHERE section = 'Other') ELSE count(*) END AS other_n
  FROM entries JOIN reports USING (run_date) GROUP BY run_date
)"""

PREVIOUS = f"""
previous AS (
  SELECT key, replace(content, 'Abstract:' || {NL} || abstract || {NL} || 'URL:',
                      'Abstract:' || {NL} || CASE WHEN lang = 'fr' THEN upper(abstract) ELSE abstract END || {NL} || 'URL:')
         AS content
  FROM corpus JOIN papers USING (key) WHERE lang <> 'de'
  UNION ALL SELECT -1 - conv_id * 1000 - turn, text FROM conversations
)"""


def fingerprints(source: str) -> str:
    word = "('0x' || substr(md5(content), {}, 8))::UBIGINT"
    sums = ", ".join(f"sum({word.format(8 * i + 1)})::VARCHAR" for i in range(4))
    return f"SELECT corpus_id, md5(concat_ws('|', count(*)::VARCHAR, {sums})) AS content_hash FROM {source} GROUP BY corpus_id"


DOCS = "docs AS (SELECT source AS corpus_id, text AS content, lang FROM documents)"

FLAGSHIP_PARTS = (
    ROUTING,
    PARSED,
    TEXTS,
    vectors_of("new", "texts"),
    vectors_of("own", "own_texts"),
    """
dots AS (SELECT a.key, b.key AS my_key, sum(a.tf * b.tf) AS dot
         FROM new_tf a JOIN own_tf b USING (bucket) GROUP BY ALL),
paper_scores AS (SELECT d.key, max(dot / (n.norm * m.norm)) AS score
                 FROM dots d JOIN new_norm n ON n.key = d.key JOIN own_norm m ON m.key = d.my_key GROUP BY d.key)""",
)

PLACED = """
placed AS (SELECT section, key, score, row_number() OVER (PARTITION BY section ORDER BY score DESC, key) AS rank
           FROM (SELECT key, section, coalesce(score, 0) AS score FROM routed LEFT JOIN paper_scores USING (key))
           JOIN win USING (key) WHERE score >= {threshold}),
recs AS (SELECT section, rank, key, score, title, authors, abstract, url, date
         FROM placed JOIN parsed USING (key) WHERE rank <= 20)"""

NEWEST_DAY = f"""
SELECT key FROM papers p WHERE (p.source IN ({listed(CATEGORIES)}) OR p.lang IN ({listed(CATEGORIES)}))
AND p.published >= (SELECT max(published) FROM papers WHERE source IN ({listed(CATEGORIES)}) OR lang IN ({listed(CATEGORIES)})) - INTERVAL '1 day'"""


def flagship(threshold: float = 0.1, window: str = "SELECT key FROM papers", own: str = "text") -> str:
    """The CTEs of a recommendation over the papers that `window` selects; `own` is the own text of an item."""
    return ",".join([f"own_texts AS (SELECT item_id AS key, {own} AS text FROM benchmark)", *FLAGSHIP_PARTS, f"win AS ({window})", PLACED.format(threshold=threshold)])


FILE_KEY = """lpad(key::VARCHAR, 12, '0') || '_' || translate(substr(title, 1, 40), '/:*?"', '_____') || '.txt'"""

ORACLES: dict[str, str] = {
    "scan_text_corpus": f"WITH {PAPERS} SELECT {FILE_KEY} AS key, url, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS content FROM corpus JOIN papers USING (key)",
    "insert_record_files": f"""WITH {PAPERS} SELECT {FILE_KEY} AS key, CASE WHEN lang = 'fr' THEN 'old ' ELSE '' END
        || replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS content FROM corpus JOIN papers USING (key)""",
    "scan_name_list": f"WITH {PAPERS} SELECT * FROM (SELECT {strip('unnest(authors)')} AS name FROM papers) WHERE name <> ''",
    "render_records": f"WITH {PAPERS} SELECT * FROM corpus",
    "paper_key": f"""WITH {PAPERS} SELECT key, key || 'v1_' || translate(title, '/:*?"', '_____') || '.txt' AS candidate_key,
        key || 'v1_' || translate(title, '/:', '__') || '.txt' AS own_key FROM papers""",
    "insert_new": """SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority <> '1-URGENT', o_orderkey) AS n FROM orders
      ) WHERE n = 1""",
    "overwrite_by_key": """SELECT user_id, event_id, event_type, value FROM events e
        WHERE event_id = (SELECT max(event_id) FROM events x WHERE x.user_id = e.user_id)""",
    "replace_snapshot": f"WITH {ROUTING} SELECT * FROM routed",
    "author_papers": """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
        WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "vector_table": f"SELECT vec_id AS key, label, {micro('embedding')} AS vec FROM embeddings",
    "category_filter": f"WITH {PAPERS} SELECT key, title FROM papers WHERE source IN ({listed(CATEGORIES)}) OR lang IN ({listed(CATEGORIES)})",
    "latest_timestamp": "SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS latest FROM events",
    "recent_window": """WITH m AS (SELECT * FROM events WHERE event_type IN ('click', 'purchase'))
        SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_type FROM m
        WHERE m.ts >= (SELECT max(ts) FROM m) - INTERVAL '1 day'""",
    "recent_window_ties": """SELECT o_orderkey, strftime(o.o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate FROM orders o
        WHERE o.o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL '30 days'""",
    "recent_window_newest": """SELECT o_orderkey, strftime(o.o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate FROM orders o
        WHERE o.o_orderdate = (SELECT max(o_orderdate) FROM orders)""",
    "score_candidates": f"WITH {SIMS} SELECT * FROM scores",
    "score_threshold": f"WITH {SIMS} SELECT key, score FROM scores WHERE score >= {THRESHOLD}",
    "top_n": f"WITH {SIMS} SELECT key, score FROM scores ORDER BY score DESC, key LIMIT 20",
    "top_n_per_section": f"""WITH {SIMS} SELECT label, rank, key, score FROM (
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, key) AS rank FROM scores) WHERE rank <= 5""",
    "retain_last_n": f"WITH {REPORTS} SELECT run_date, md FROM reports ORDER BY run_date DESC LIMIT 7",
    "line_field": f"WITH {PAPERS} SELECT key, {strip('title')} AS title FROM papers",
    "block_field": f"WITH {PAPERS} SELECT key, {block_field('Abstract:', 'Date:')} AS block FROM corpus",
    "parse_records": f"WITH {PAPERS}, {PARSED} SELECT * FROM parsed",
    "compose_text": f"WITH {PAPERS}, {TEXTS} SELECT * FROM texts",
    "substitute_separator": f"WITH {PAPERS}, {TEXTS} SELECT key, replace(replace(text, ' [SEP] ', ' </s> '), '[SEP]', '</s>') AS text FROM texts",
    "explode_authors": f"WITH {PAPERS}, {AUTHORS} SELECT key, pos, author FROM author_rows",
    "normalize_names": f"WITH {PAPERS}, {AUTHORS}, {AUTHOR_PARTS} SELECT key, pos, first, last FROM author_parts",
    "tokenize_stopwords": f"""SELECT doc_id AS key, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\pL]+'),
        lambda w: w <> '' AND w NOT IN ({listed(STOPWORDS)})), ' ') AS tokens FROM documents""",
    "author_match": f"WITH {MATCHING} SELECT key, pos, author FROM author_parts a WHERE {matches('quality', STRICT)}",
    "author_match_loose": f"WITH {MATCHING} SELECT key, pos, author FROM author_parts a WHERE {matches('quality', LOOSE)}",
    "exclude_authors": f"WITH {ROUTING} SELECT key FROM flagged WHERE NOT black",
    "route_priority": f"WITH {ROUTING} SELECT key, section FROM routed",
    "routing_counts": f"""WITH {ROUTING} SELECT count(*) FILTER (WHERE black) AS blacklisted,
        count(*) FILTER (WHERE NOT black AND white) AS priority, count(*) FILTER (WHERE NOT black AND NOT white) AS rest FROM flagged""",
    "flag_authors": f"""WITH {MATCHING}, marked AS (SELECT key, string_agg(author || CASE WHEN {matches('quality', LOOSE)} THEN '=yes' ELSE '=no' END, '; ' ORDER BY pos) AS flags
        FROM author_parts a GROUP BY key) SELECT c.key, coalesce(flags, '') AS flags FROM corpus c LEFT JOIN marked USING (key)""",
    "cosine_pairs": f"WITH {SIMS} SELECT key, my_key, round(sim, 6) AS sim FROM sims WHERE sim >= {PAIR_FLOOR}",
    "cosine_pairs_grouped": f"WITH {SIMS} SELECT key, my_key, round(sim, 6) AS sim FROM sims WHERE sim >= {PAIR_FLOOR}",
    "score_candidates_grouped": f"WITH {SIMS} SELECT key, label, score FROM scores",
    "max_similarity": f"WITH {SIMS} SELECT key, score FROM scores",
    "check_dims": """WITH n AS (SELECT min(len(embedding)) AS new_min, max(len(embedding)) AS new_max FROM embeddings WHERE label <> 0),
        m AS (SELECT min(len(embedding)) AS mine_min, max(len(embedding)) AS mine_max FROM embeddings WHERE label = 0)
        SELECT *, new_min = new_max AND mine_min = mine_max AND new_min = mine_min AS agree FROM n, m""",
    "l2_normalize": f"""WITH scaled AS (SELECT vec_id, list_transform(embedding, lambda x: (x * label)::FLOAT)::DOUBLE[] AS v FROM embeddings),
        normed AS (SELECT *, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12) AS n FROM scaled)
        SELECT vec_id, {micro("list_transform(v, lambda y: y / n)")} AS vec FROM normed""",
    "mean_pool": f"""WITH {TOKENS}, means AS (SELECT key, dim, sum(x * mask) / greatest(sum(mask)::DOUBLE, 1e-9) AS x FROM token_dims GROUP BY key, dim)
        SELECT key, {micro("list(x ORDER BY dim)")} AS vec FROM means GROUP BY key""",
    "first_token_pool": f"WITH {TOKENS} SELECT key, {micro('list(x ORDER BY dim)')} AS vec FROM token_dims WHERE pos = 0 GROUP BY key",
    "embed": f"WITH {PAPERS}, {TEXTS}, {vectors_of('v', 'texts')} SELECT key, {micro('vec')} AS vec FROM v",
    "embed_encoder": f"WITH {PAPERS}, {TEXTS}, {vectors_of('v', 'texts')} SELECT key, {micro('vec')} AS vec FROM v",
    "embed_padded": f"""WITH {PAPERS}, {TEXTS}, cut AS (SELECT key, array_to_string(({words("text")})[1:{MAX_TOKENS}], ' ') AS text FROM texts),
        {vectors_of('v', 'cut')} SELECT key, len({words("text")})::INT AS n_tokens, {micro('vec')} AS vec FROM v JOIN cut USING (key)""",
    "attach_records": f"WITH {REPORTS} SELECT key, run_date, section, round(score, 6) AS score, rank, title, authors, abstract, url, date FROM recs",
    "render_entries": f"WITH {REPORTS} SELECT run_date, section, rank, entry || {NL} || {NL} || '---' || {NL} || {NL} AS entry FROM entries",
    "assemble_report": f"WITH {REPORTS} SELECT run_date, md FROM reports",
    "report_sink": f"WITH {REPORTS} SELECT run_date, md FROM reports",
    "report_lines": f"""WITH {REPORTS}, whole AS (SELECT run_date, string_split(substr(md, 1, length(md) - 1), {NL}) AS lines FROM reports)
        SELECT run_date, generate_subscripts(lines, 1) - 1 AS line_no, unnest(lines) AS line FROM whole""",
    "split_sections": f"""WITH {REPORTS} SELECT run_date,
        CASE WHEN two_sections THEN {strip(f"substr(priority_md, {len('## Priority (whitelist authors)') + 1})")} ELSE '' END AS priority,
        CASE WHEN two_sections THEN {strip(f"substr(other_md, {len('## Other recommendations') + 1})")} ELSE md END AS other
        FROM reports JOIN md_parts USING (run_date)""",
    "count_entries": f"WITH {REPORTS}, {COUNTS} SELECT * FROM counts",
    "split_entries": f"WITH {REPORTS}, {SHOWN} SELECT run_date, section, pos, {strip('entry')} AS entry FROM shown",
    "split_line_entries": f"""WITH {REPORTS}, {SHOWN} SELECT run_date, section, pos::INT AS pos, {strip('entry')} AS entry FROM shown""",
    "parse_entries": f"""WITH {REPORTS}, {SHOWN} SELECT run_date, section, pos, {LINK_TITLE} AS title, {LINK_URL} AS url,
        authors, date, printf('%.4f', score)::DOUBLE AS score, abstract FROM shown""",
    "entry_links": f"WITH {REPORTS}, {SHOWN} SELECT run_date, section, pos, {LINK_TITLE} AS title, {LINK_URL} AS url FROM shown",
    "sanitize_abstract": """WITH q AS (SELECT doc_id AS key, translate(replace(text, '. ', '```'), ',v', '`''') AS a FROM documents)
        SELECT key, replace(regexp_replace(replace(regexp_replace(regexp_replace(a, '```[\\s\\S]*?```', '', 'g'),
          '`([^''\\n]+)''', '''\\1''', 'g'), '``', '"'), '`([^`]+)`', '\\1', 'g'), '`', '''') AS abstract FROM q""",
    "score_bands": f"""WITH {PAPERS}, {SCORED}, b AS (SELECT key, CASE WHEN section = 'Other' THEN round(score, 4) END AS score FROM scored),
        c AS (SELECT *, coalesce(score, 0) AS s, greatest(least(round_even(coalesce(score, 0) * 100, 0), 100), 0)::INT AS percent FROM b),
        d AS (SELECT *, CASE WHEN s >= {BAND_THRESHOLD + 0.1}::DOUBLE THEN 'green' WHEN s >= {BAND_THRESHOLD}::DOUBLE THEN 'amber' ELSE 'red' END AS band FROM c)
        SELECT key, score, band, CASE band WHEN 'green' THEN '#22c55e' WHEN 'amber' THEN '#f59e0b' ELSE '#ef4444' END AS color,
               percent, greatest(percent, 1) AS fill FROM d""",
    "paper_links": f"""WITH {PAPERS}, urls AS (
          SELECT unnest([url, 'http://h/abs/' || key || 'v2?context=x', 'http://h/html/' || key || '#top', 'http://h/pdf/' || key]) AS url FROM papers
          UNION ALL SELECT url FROM pages),
        ids AS (SELECT url, coalesce(nullif(regexp_extract(url, '/pdf/([^/]+)\\.pdf', 1), ''), nullif(regexp_extract(url, '/abs/([^/?#]+)', 1), ''),
                                     regexp_extract(url, '/html/([^/?#]+)', 1)) AS paper_id FROM urls)
        SELECT *, CASE WHEN paper_id <> '' THEN 'https://papers.example/abs/' || paper_id ELSE '' END AS abs_url,
               CASE WHEN paper_id <> '' THEN 'https://papers.example/html/' || paper_id ELSE '' END AS html_url FROM ids""",
    "display_defaults": f"""WITH {REPORTS} SELECT key, CASE WHEN section = 'Other' THEN title ELSE 'Untitled' END AS title,
        CASE WHEN section = 'Other' THEN '#' ELSE url END AS url,
        CASE WHEN section = 'Other' THEN round(score, 4)::VARCHAR ELSE 'N/A' END AS score_label FROM recs""",
    "run_history": f"""WITH {REPORTS}, {COUNTS} SELECT run_date, {DATE_LABEL} || ' — Priority ' || priority_n || ', Other ' || other_n AS label,
        priority_n, other_n FROM counts""",
    "run_history_latest": f"""WITH {REPORTS}, {COUNTS}, readable AS (SELECT run_date, CASE WHEN run_date LIKE '%7' THEN 0 ELSE priority_n END AS priority_n,
        CASE WHEN run_date LIKE '%7' THEN 0 ELSE other_n END AS other_n FROM counts)
        SELECT run_date, {DATE_LABEL} || ' — Priority ' || priority_n || ', Other ' || other_n AS label,
        priority_n, other_n FROM readable ORDER BY run_date DESC LIMIT 5""",
    "export_links": f"""WITH {REPORTS}, {SHOWN} SELECT run_date, section, string_agg(url, {NL} ORDER BY pos) AS links
        FROM (SELECT run_date, section, pos, {LINK_URL} AS url FROM shown)
        WHERE url IN (SELECT 'http://h/pdf/' || doc_id || '.pdf' FROM labels WHERE quality = 1) GROUP BY run_date, section""",
    "changed_rows": f"""WITH {PAPERS}, {PREVIOUS} SELECT coalesce(p.key, c.key) AS key, CASE WHEN p.key IS NULL THEN 'new' WHEN c.key IS NULL THEN 'removed'
        WHEN p.content = c.content THEN 'unchanged' ELSE 'changed' END AS change FROM previous p FULL JOIN corpus c ON p.key = c.key""",
    "changed_rows_localised": f"""WITH {PAPERS}, {PREVIOUS} SELECT coalesce(p.key, c.key) AS key, CASE WHEN p.key IS NULL THEN 'new' WHEN c.key IS NULL THEN 'removed'
        WHEN p.content = c.content THEN 'unchanged' ELSE 'changed' END AS change FROM previous p FULL JOIN corpus c ON p.key = c.key""",
    "poll_with_state": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    "corpus_fingerprint": f"WITH {DOCS} {fingerprints('docs')}",
    "model_fingerprint": "SELECT vec_id AS key, 'older|adapters=False|base=|adapter=' AS fingerprint FROM embeddings WHERE label BETWEEN 1 AND 4",
    "rebuild_decision": f"""WITH {DOCS}, known AS (SELECT * FROM docs WHERE lang <> 'es' AND corpus_id NOT LIKE 'src1%'),
        now AS ({fingerprints('docs')}), last AS ({fingerprints('known')})
        SELECT now.corpus_id, last.content_hash IS NULL OR last.content_hash <> now.content_hash OR now.corpus_id = 'src7'
               OR now.corpus_id LIKE '%3' AS rebuild FROM now LEFT JOIN last USING (corpus_id)""",
    "incremental_vectors": f"""WITH {PAPERS}, {TEXTS}, {vectors_of('v', 'texts')}
        SELECT key, md5(content) AS content_hash, '{FINGERPRINT}' AS fingerprint, {micro('vec')} AS vec FROM v JOIN corpus USING (key)""",
    "vector_store": f"""WITH {PAPERS}, {TEXTS}, {vectors_of('v', 'texts')}
        SELECT key, md5(content) AS content_hash, '{FINGERPRINT}' AS fingerprint, {micro('list_transform(vec, lambda y: y::FLOAT)')} AS vec FROM v JOIN corpus USING (key)""",
    "recommend": f"WITH {flagship()} SELECT * REPLACE (round(score, 6) AS score) FROM recs",
    "recommend_directory": f"WITH {flagship()} SELECT * REPLACE (round(score, 6) AS score, {FILE_KEY} AS key) FROM recs",
    "recommend_duplicates": f"WITH {flagship()} SELECT * REPLACE (round(score, 6) AS score) FROM recs",
    "recommend_window": f"WITH {flagship(0.0, NEWEST_DAY)} SELECT * REPLACE (round(score, 6) AS score) FROM recs",
    "daily_job": f"""WITH {flagship(own=f"'b [SEP] ' || {strip('text')}")}, entries AS (SELECT *, '2024-02-01' AS run_date, {ENTRY} AS entry FROM recs), {MD}
        SELECT run_date, md, (SELECT count(*) FROM benchmark) AS vectors FROM reports
        UNION ALL SELECT '2024-02-02', {NL}, (SELECT count(*) FROM benchmark)""",
    "recommend_report": f"""WITH {flagship()}, entries AS (SELECT *, '2024-02-01' AS run_date, {ENTRY} AS entry FROM recs), {MD}
        SELECT run_date, md FROM reports""",
}
