"""DuckDB SQL for the queries that SQL can state."""

from __future__ import annotations

#: Equal lines of two places, joined to runs along their diagonal; a run of 8 words or more is a later copy.
OP5 = r"""
WITH line AS (
  SELECT doc_id, text, l.no AS line_no, l.line
  FROM documents, LATERAL (
    SELECT generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no, unnest(string_split(text, chr(10))) AS line
  ) l
), solid AS (
  SELECT doc_id, line_no, line, len(regexp_extract_all(line, '\S+')) AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS seq
  FROM line WHERE regexp_matches(line, '\S')
), pair AS (
  SELECT a.doc_id AS da, b.doc_id AS db, a.seq AS sa, b.seq AS sb, b.line_no, b.words,
         b.seq - row_number() OVER (PARTITION BY a.doc_id, b.doc_id, b.seq - a.seq ORDER BY b.seq) AS island
  FROM solid a JOIN solid b ON a.line = b.line AND (a.doc_id, a.seq) < (b.doc_id, b.seq)
), gone AS (
  SELECT DISTINCT db AS doc_id, line_no
  FROM (SELECT *, sum(words) OVER (PARTITION BY da, db, sb - sa, island) AS run_words FROM pair)
  WHERE run_words >= 8
)
SELECT doc_id,
       count(line_no)::BIGINT AS n_lines,
       count(*) FILTER (WHERE lost)::BIGINT AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT lost), '')) AS kept_md5
FROM (
  SELECT line.doc_id, line.line_no, line.line, gone.doc_id IS NOT NULL AS lost
  FROM line LEFT JOIN gone ON line.doc_id = gone.doc_id AND line.line_no = gone.line_no
)
GROUP BY doc_id
"""

ORACLES: dict[str, str] = {"op5_line_dedup": OP5}
