"""The queries for training data, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import boilerplate, bpe, encoding, history, maintext, packing, repetition, residue, truncation

QUERIES = {
    "p1_found": history.p1_found,
    "p2_found": residue.p2_found,
    "p3_found": truncation.p3_found,
    "p3_shares": truncation.p3_shares,
    "p4_found": boilerplate.p4_found,
    "p4_blocks": boilerplate.p4_blocks,
    "p4_cleaned": boilerplate.p4_cleaned,
    "p5_found": maintext.p5_found,
    "p6_found": encoding.p6_found,
    "p6_repaired": encoding.p6_repaired,
    "p6_letters": encoding.p6_letters,
    "p8_ids": bpe.p8_ids,
    "p9_containers": packing.p9_containers,
    "p10_found": repetition.p10_found,
    "p10_ablation": repetition.p10_ablation,
}
ORACLE: dict[str, str] = {
    "p4_found": r"""WITH t AS (SELECT extraction_id, regexp_replace(lower(regexp_extract(trim(resolved_url), '(?i)^(?:https?:)?//(?:[^/?#@]*@)?([^/?#:\s]*)', 1)), '^(?:www|m|amp)\.|\.$', '', 'g') AS site, string_split(body_text, chr(10)) AS ls FROM article_extractions WHERE body_text IS NOT NULL),
    l AS (SELECT extraction_id, site, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM t),
    k AS (SELECT extraction_id, site, line_no, regexp_replace(lower(trim(regexp_replace(line, '[\s\x00-\x1f\x85\xa0\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]+', ' ', 'g'))), '[0-9]+', '0', 'g') AS k FROM l)
    SELECT extraction_id, CAST(line_no AS INT) AS line_no FROM k JOIN (SELECT site, k FROM k WHERE k <> '' AND site <> '' GROUP BY 1, 2 HAVING count(DISTINCT extraction_id) >= 5) USING (site, k)""",
}
