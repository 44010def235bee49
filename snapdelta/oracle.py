"""DuckDB SQL of the engine's queries, over the same snapshots of the driver's tables."""

from __future__ import annotations

import re

ASSOCIATIONS = {"SPECIALIZATION": (8, "|>", "<|"), "REALIZATION": (8, "|>", "<|"), "COMPOSITION": (6, "*", "*"), "AGGREGATION": (6, "o", "o"), "ASSOCIATION": (3, ">", "<"), "WEAK_ASSOCIATION": (1, ">", "<"), "NONE": (-1, "", "")}
PALETTE = ["f0fffa", "f0fffd", "f9fff0", "f0f1ff", "fff0ff", "f0f8ff", "f0ffff", "fffaf0", "f5f5dc", "f8f4ff", "f5f5dc", "f8f8ff", "f8f8f9", "e7e8ee", "fdecd5"]
LARGE = 20
STYLE = {
    "added_component_color": "#bef5cb", "deleted_component_color": "#fdaeb7", "modified_component_color": "#b3e3f5", "class_font_color": "#FFDEAD", "background_color": "#f8f8f8",
    "default_class_header_color": "#24292e", "added_relation_color": "#00cc00", "deleted_relation_color": "#cc0000", "class_arrow_color": "#464646",
}
BASES = "('CLASS', 'INTERFACE', 'STRUCT')"


def _strength(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {a[0]}" for k, a in ASSOCIATIONS.items()) + " END"


def _ends(column: str, way: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{a[1 if way == 'forward' else 2]}'" for k, a in ASSOCIATIONS.items()) + " END"


def _components(s: str, parts: str, orders: str, hash_: str, modifier: str) -> str:
    return f"""
{s}_p AS (SELECT * FROM parts WHERE p_partkey % 20 <> {parts}),
{s}_m AS (SELECT * REPLACE ({hash_} AS code_hash, {modifier} AS modifier) FROM members WHERE l_orderkey % 10 <> {orders}),
{s}_c AS (
  SELECT unique_name, name, component_type, NULL AS parent_name, pkg, source_file, NULL AS modifier, code_hash, NULL AS code_fragment, comment FROM {s}_p
  UNION ALL
  SELECT unique_name, name, component_type, parent_name, pkg, source_file, modifier, code_hash, name || CASE component_type WHEN 'METHOD' THEN '()' ELSE '' END, NULL FROM {s}_m),
{s}_r AS (
  SELECT DISTINCT a.unique_name, 'simple' AS kind, b.parent_name AS target FROM {s}_m a JOIN {s}_m b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  UNION ALL
  SELECT unique_name, CASE next_type WHEN 'INTERFACE' THEN 'implementation' ELSE 'extension' END, next_name
  FROM (SELECT unique_name, lead(unique_name) OVER w AS next_name, lead(component_type) OVER w AS next_type FROM {s}_p WINDOW w AS (PARTITION BY pkg ORDER BY p_partkey)) WHERE next_name IS NOT NULL),
{s}_k AS (SELECT parent_name AS parent, unique_name AS child FROM {s}_m WHERE parent_name IN (SELECT unique_name FROM {s}_p)),"""


def _edges(s: str) -> str:
    return f"""
{s}_b AS (SELECT c.*, CASE WHEN c.component_type IN {BASES} THEN c.unique_name ELSE p.unique_name END AS base FROM {s}_c c LEFT JOIN {s}_c p ON c.parent_name = p.unique_name),
{s}_e AS (
  SELECT source, target, association, strength FROM (
    SELECT *, row_number() OVER (PARTITION BY source, target, strength ORDER BY origin, phase, association) AS place FROM (
      SELECT *, {_strength("association")} AS strength FROM (
        SELECT h.base AS source, t.base AS target, h.unique_name AS origin,
          CASE WHEN h.component_type NOT IN {BASES} THEN 2 WHEN r.kind = 'implementation' THEN 1 ELSE 0 END AS phase,
          CASE WHEN h.component_type IN {BASES} THEN CASE r.kind WHEN 'extension' THEN 'SPECIALIZATION' WHEN 'implementation' THEN 'REALIZATION' END
            WHEN h.component_type = 'FIELD' THEN CASE WHEN h.modifier IN ('private', 'protected') THEN 'COMPOSITION' ELSE 'AGGREGATION' END
            ELSE 'WEAK_ASSOCIATION' END AS association
        FROM {s}_r r JOIN {s}_b h ON r.unique_name = h.unique_name JOIN {s}_b t ON r.target = t.unique_name
        WHERE h.base IS NOT NULL AND t.base IS NOT NULL AND r.target <> h.base AND h.base <> t.base)
      WHERE association IS NOT NULL)) WHERE place = 1),
{s}_t AS (SELECT source, target, max(ROW(strength, association)) AS top FROM {s}_e GROUP BY ALL),
{s}_s AS (SELECT source, target, top[2] AS association, top[1] AS strength FROM {s}_t),"""


PRELUDE = (
    """WITH parts AS (
  SELECT p_partkey, p_brand AS pkg, p_brand || '.P' || p_partkey AS unique_name, 'P' || p_partkey AS name, CASE p_size % 3 WHEN 0 THEN 'CLASS' WHEN 1 THEN 'INTERFACE' ELSE 'STRUCT' END AS component_type,
    '/' || p_brand || '/P' || p_partkey || '.java' AS source_file, CAST(p_size AS INTEGER) AS code_hash, p_name AS comment FROM part),
members AS (
  SELECT l_orderkey, l_linenumber, p.unique_name AS parent_name, p.pkg, p.source_file, CAST(floor(max(l_quantity)) AS INTEGER) AS code_hash,
    p.unique_name || '.m' || l_orderkey || '_' || l_linenumber AS unique_name, 'm' || l_orderkey || '_' || l_linenumber AS name,
    CASE l_linenumber % 3 WHEN 0 THEN 'FIELD' WHEN 1 THEN 'METHOD' ELSE 'CONSTRUCTOR' END AS component_type,
    CASE max(l_returnflag) WHEN 'A' THEN 'private' WHEN 'R' THEN 'protected' ELSE 'public' END AS modifier
  FROM lineitem JOIN parts p ON l_partkey = p_partkey GROUP BY l_orderkey, l_linenumber, p.unique_name, p.pkg, p.source_file),"""
    + _components("o", "0", "0", "code_hash", "modifier")
    + _components("n", "1", "1", "CAST(code_hash + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS INTEGER)", "CASE WHEN l_orderkey % 11 <> 0 THEN modifier WHEN modifier = 'private' THEN 'public' ELSE 'private' END")
    + """
g_c AS (SELECT * FROM n_c UNION ALL SELECT * FROM o_c WHERE unique_name NOT IN (SELECT unique_name FROM n_c)),
g_r AS (SELECT * FROM n_r UNION ALL SELECT * FROM o_r WHERE unique_name NOT IN (SELECT unique_name FROM n_c)),
g_k AS (SELECT * FROM n_k UNION SELECT * FROM o_k),"""
    + _edges("o")
    + _edges("n")
    + _edges("g")
    + f"""
cc AS (
  SELECT n.unique_name, n.component_type, 'added' AS change FROM n_c n WHERE n.unique_name NOT IN (SELECT unique_name FROM o_c)
  UNION ALL SELECT o.unique_name, o.component_type, 'deleted' FROM o_c o WHERE o.unique_name NOT IN (SELECT unique_name FROM n_c)
  UNION ALL SELECT n.unique_name, n.component_type, 'modified' FROM n_c n JOIN o_c o ON n.unique_name = o.unique_name WHERE n.code_hash <> o.code_hash),
rc AS (
  SELECT n.*, 'added' AS change FROM n_e n WHERE NOT EXISTS (SELECT 1 FROM o_e o WHERE o.source = n.source AND o.target = n.target AND o.strength = n.strength)
  UNION ALL SELECT o.*, 'deleted' FROM o_e o WHERE NOT EXISTS (SELECT 1 FROM n_e n WHERE o.source = n.source AND o.target = n.target AND o.strength = n.strength)),
kr AS (SELECT DISTINCT unique_name FROM (SELECT source AS unique_name FROM rc UNION ALL SELECT target FROM rc) WHERE unique_name NOT IN (SELECT unique_name FROM cc WHERE change <> 'modified')),
chg AS (SELECT unique_name, change FROM cc UNION ALL SELECT unique_name, 'key_relation' FROM kr),
nd AS (SELECT * FROM g_c WHERE unique_name IN (SELECT b.base FROM chg JOIN g_b b USING (unique_name))),
ed AS (SELECT * FROM g_e WHERE source IN (SELECT unique_name FROM nd) AND target IN (SELECT unique_name FROM nd)),
tp AS (SELECT * FROM g_s WHERE source IN (SELECT unique_name FROM nd) AND target IN (SELECT unique_name FROM nd)),
flag AS (SELECT unique_name, min(CASE change WHEN 'added' THEN 0 WHEN 'deleted' THEN 1 WHEN 'modified' THEN 2 END) AS rank FROM cc GROUP BY 1),
colors AS (SELECT pkg AS package_path, ['{"', '".join("#" + c for c in PALETTE)}'][1 + (row_number() OVER (ORDER BY pkg) - 1) % {len(PALETTE)}] AS color FROM (SELECT DISTINCT pkg FROM nd)),
mut AS (
  SELECT f.source, f.target, f.association, f.strength, coalesce(r.association, 'NONE') AS reverse_association, coalesce(r.strength, -1) AS reverse_strength
  FROM tp f LEFT JOIN tp r ON r.source = f.target AND r.target = f.source),
kid AS (SELECT k.parent, k.child, c.component_type, c.name, c.code_fragment, c.modifier, c.code_hash AS c_hash, count(*) OVER (PARTITION BY k.parent) AS n FROM g_k k JOIN g_c c ON k.child = c.unique_name)
"""
)


#: The prelude's tables by name, each with its text.
_TABLES = {m[1]: m[2] for m in re.finditer(r"^(?:WITH )?(\w+) AS (\(.*?\))(?=,?\s*^\w+ AS \(|,?\s*\Z)", PRELUDE, re.DOTALL | re.MULTILINE)}


def sql(body: str) -> str:
    """The query with those of the prelude's tables that it needs."""
    wanted, todo = set(), [body]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in words & set(_TABLES) - wanted:
            wanted.add(name)
            todo.append(_TABLES[name])
    return "WITH " + ",\n".join(f"{k} AS {t}" for k, t in _TABLES.items() if k in wanted) + "\n" + body


CHANGE = "CASE rank WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'modified' ELSE 'unchanged' END"


def _plain(name: str) -> str:
    return STYLE[name].replace("#", "")


def _body(association: str, color: str) -> str:
    tag = f"'[' || {color} || ']'"
    return f"CASE WHEN {association} = 'REALIZATION' THEN '--.-' || {tag} || '-' WHEN {association} IN ('ASSOCIATION', 'WEAK_ASSOCIATION') THEN '--' || {tag} ELSE '--' || {tag} || '--' END"


def _end(own: str, other: str, way: str) -> str:
    whole = "('COMPOSITION', 'AGGREGATION')"
    return f"CASE WHEN {own} IN {whole} THEN {_ends(own, way)} WHEN {other} NOT IN {whole} THEN {_ends(other, way)} ELSE '' END"


def _color(flag: str) -> str:
    return f"CASE {flag} WHEN 'added' THEN '{STYLE['added_relation_color']}' WHEN 'deleted' THEN '{STYLE['deleted_relation_color']}' ELSE '{STYLE['class_arrow_color']}' END"


WRAPPED = r"rtrim(regexp_replace(trim(regexp_replace(text, '[ \t\n\f\r]+', ' ', 'g')), '(.{1,80})(?: |$)', '\1' || chr(10), 'g'), chr(10))"

SHOWN = "trim(CASE WHEN c_hash % 3 = 0 THEN '{abstract} ' ELSE '' END || CASE WHEN c_hash % 2 = 0 THEN '{static} ' ELSE '' END || code_fragment)"
GIVEN = f"""given AS (
  SELECT source, target, m[1] AS association, strength, m[2] AS multiplicity FROM (
    SELECT source, target, strength, min(ROW(association, multiplicity)) AS m FROM (
      SELECT *, {_strength("association")} AS strength FROM (
        SELECT 'P' || (l_partkey % 50) AS source, 'S' || (l_suppkey % 20) AS target, ['', '0..1', '0..*'][1 + l_orderkey % 3] AS multiplicity,
          ['SPECIALIZATION', 'REALIZATION', 'COMPOSITION', 'AGGREGATION', 'ASSOCIATION', 'WEAK_ASSOCIATION', 'NONE', 'NONE'][1 + l_linenumber % 8] AS association FROM lineitem)) GROUP BY ALL))"""
FILES = "SELECT '/' || source || '/' || doc_id || ['.java', '.py', '.txt'][1 + doc_id % 3] AS path, text AS content, doc_id FROM documents"
REFS = "SELECT unique_name, list_sort(list(DISTINCT {'kind': kind, 'target': target})) AS refs FROM g_r GROUP BY 1"
COMPONENT = "{'uniqueName': unique_name, 'modifiers': [], 'componentType': component_type, 'refs': coalesce(refs, []), 'name': name, 'comment': comment, 'sourceFile': source_file, 'package': {'path': pkg, 'name': pkg}, 'componentName': name}"
RELATION = "{'strength': strength, 'originalComponent': source, 'targetComponent': target, 'targetComponentRelationMultiplicity': '', 'associationType': association}"


def _names(change: str) -> str:
    return f"(SELECT coalesce(list_sort(list(DISTINCT unique_name)), []) FROM chg WHERE change = '{change}')"


def _related(change: str) -> str:
    return f"(SELECT coalesce(list_sort(list(DISTINCT {{'source': source, 'target': target, 'association': association, 'strength': strength}})), []) FROM rc WHERE change = '{change}')"


def _times(column: str) -> str:
    return f"CASE WHEN {column} IN ('', '0..1') THEN '' ELSE '\"' || {column} || '\" ' END"


CHANGE_SET = f"{{'addedComponents': {_names('added')}, 'deletedComponents': {_names('deleted')}, 'modifiedComponents': {_names('modified')}, 'keyRelationsComponents': {_names('key_relation')}, 'addedRelations': {_related('added')}, 'deletedRelations': {_related('deleted')}}}"

ORACLE: dict[str, str] = {
    "component_change_summary": sql("SELECT change, component_type, count(*) AS n FROM cc GROUP BY ALL"),
    **{f"components_{c}": sql(f"SELECT unique_name, component_type FROM cc WHERE change = '{c}'") for c in ("added", "deleted", "modified")},
    "base_of_component": sql("SELECT unique_name, base FROM g_b WHERE base IS NOT NULL"),
    "relations_all": sql("SELECT * FROM n_e"),
    "relations_specialization": sql("SELECT * FROM n_e WHERE association = 'SPECIALIZATION'"),
    "relations_realization": sql("SELECT * FROM n_e WHERE association = 'REALIZATION'"),
    "relations_association": sql("SELECT * FROM n_e WHERE association IN ('COMPOSITION', 'AGGREGATION', 'ASSOCIATION', 'WEAK_ASSOCIATION')"),
    "relations_strongest": sql("SELECT * FROM n_s"),
    "relations_of_component": sql("SELECT * FROM n_e WHERE source = (SELECT min(unique_name) FROM n_p)"),
    "relations_mutual": sql("SELECT f.source, f.target, f.association, r.association AS reverse_association FROM n_s f JOIN n_s r ON r.source = f.target AND r.target = f.source"),
    "relations_added": sql("SELECT source, target, association, strength FROM rc WHERE change = 'added'"),
    "relations_deleted": sql("SELECT source, target, association, strength FROM rc WHERE change = 'deleted'"),
    "relations_changed_strictly": sql("""SELECT *, 'added' AS change FROM (SELECT * FROM n_e EXCEPT SELECT * FROM o_e) UNION ALL SELECT *, 'deleted' FROM (SELECT * FROM o_e EXCEPT SELECT * FROM n_e)"""),
    "key_relation_components": sql("SELECT unique_name FROM kr"),
    "change_counts": sql("SELECT change, count(*) AS n FROM chg GROUP BY 1"),
    "merged_components": sql("SELECT unique_name, component_type, parent_name, source_file, code_hash FROM g_c"),
    "merged_children": sql("SELECT parent, child FROM g_k"),
    "merged_relations": sql("SELECT * FROM g_e"),
    "diagram_nodes": sql("SELECT unique_name, component_type, pkg AS package_path FROM nd"),
    "diagram_nodes_filtered": sql("SELECT unique_name FROM g_c WHERE unique_name IN (SELECT b.base FROM chg JOIN g_b b USING (unique_name) WHERE b.source_file IN ('/Brand#11/P1.java', '/Brand#12/P12.java', (SELECT min(source_file) FROM parts), (SELECT max(source_file) FROM parts)))"),
    "diagram_edges": sql("SELECT * FROM ed"),
    "edge_change_flags": sql("SELECT e.*, coalesce(c.change, 'unchanged') AS change FROM ed e LEFT JOIN (SELECT source, target, strength, min(change) AS change FROM rc GROUP BY ALL) c USING (source, target, strength)"),
    "node_change_flags": sql(f"SELECT n.unique_name, {CHANGE} AS change FROM nd n LEFT JOIN flag USING (unique_name)"),
    "package_groups": sql("SELECT pkg AS package_path, count(*) AS size, string_agg(unique_name, ',' ORDER BY unique_name) AS members FROM nd GROUP BY 1"),
    "package_colors": sql("SELECT * FROM colors"),
    "diagram_summary": sql("SELECT pkg AS diagram, pkg AS packages, count(*) AS size, count(*) <= 120 AS drawn FROM nd GROUP BY pkg"),
    "class_children_display": sql(f"""SELECT parent, child, component_type IN ('FIELD', 'ENUM_CONSTANT', 'INTERFACE_CONSTANT') AS is_field,
      CASE modifier WHEN 'public' THEN '+' WHEN 'private' THEN '-' WHEN 'protected' THEN '#' ELSE '~' END || '  '
      || CASE rank WHEN 0 THEN '<back:{STYLE["added_component_color"]}>' || code_fragment || '</back>         ' WHEN 1 THEN '<back:{STYLE["deleted_component_color"]}>' || code_fragment || '</back>         '
        WHEN 2 THEN '<back:{STYLE["modified_component_color"]}>' || code_fragment || '</back>         ' ELSE code_fragment END || chr(10) AS line
      FROM kid LEFT JOIN flag ON child = flag.unique_name WHERE component_type IN ('FIELD', 'METHOD') AND (n <= {LARGE} OR rank IS NOT NULL) AND parent IN (SELECT unique_name FROM nd)"""),
    "class_headers": sql(f"""SELECT unique_name, lower(component_type) || ' ' || replace(unique_name, '.', '-') || ' as "' || name || CASE WHEN n > {LARGE} THEN ' <b><color:{STYLE["class_font_color"]}>(...)' ELSE '' END || '" #back:'
      || CASE rank WHEN 0 THEN '{_plain("added_component_color")}' WHEN 1 THEN '{_plain("deleted_component_color")}' ELSE '{_plain("background_color")}' END || ';header:{_plain("default_class_header_color")} ' AS header
      FROM nd LEFT JOIN flag USING (unique_name) LEFT JOIN (SELECT parent AS unique_name, count(*) AS n FROM kid GROUP BY 1) USING (unique_name)"""),
    "diagram_ids": sql("SELECT unique_name, pkg || '.' || replace(unique_name, '.', '-') AS id FROM nd"),
    "edge_lines": sql(f"""SELECT m.source, m.target, '"' || a.pkg || '.' || replace(m.source, '.', '-') || '" ' || {_end("association", "reverse_association", "backward")}
      || CASE WHEN m.strength > reverse_strength THEN {_body("association", _color("f.change"))} ELSE {_body("reverse_association", _color("r.change"))} END
      || {_end("reverse_association", "association", "forward")} || '"' || b.pkg || '.' || replace(m.target, '.', '-') || '" ' || chr(10) AS line
      FROM mut m JOIN nd a ON a.unique_name = m.source JOIN nd b ON b.unique_name = m.target
      LEFT JOIN (SELECT source, target, strength, min(change) AS change FROM rc GROUP BY ALL) f ON f.source = m.source AND f.target = m.target AND f.strength = m.strength
      LEFT JOIN (SELECT source, target, strength, min(change) AS change FROM rc GROUP BY ALL) r ON r.source = m.target AND r.target = m.source AND r.strength = m.reverse_strength"""),
    "augmented_nodes": sql("SELECT unique_name, lower(component_type) AS note FROM nd UNION SELECT unique_name, lower(component_type) FROM g_c WHERE component_type = 'INTERFACE'"),
    "decorated_ends": sql("SELECT unique_name, ' note ' || component_type || chr(10) || '}' || chr(10) AS \"end\" FROM nd"),
    "modifier_lines": sql(f"""SELECT parent, child, CASE modifier WHEN 'public' THEN '+' WHEN 'private' THEN '-' WHEN 'protected' THEN '#' ELSE '~' END || '  '
      || CASE rank WHEN 0 THEN '<back:#abcdef>' || {SHOWN} || '</back>         ' WHEN 1 THEN '<back:#fdaeb7>' || {SHOWN} || '</back>         '
        WHEN 2 THEN '<back:#b3e3f5>' || {SHOWN} || '</back>         ' ELSE {SHOWN} END || chr(10) AS line
      FROM kid LEFT JOIN flag ON child = flag.unique_name WHERE component_type IN ('FIELD', 'METHOD') AND (n <= 20 OR rank IS NOT NULL) AND parent IN (SELECT unique_name FROM nd)"""),
    "edges_drawable": sql("""SELECT * FROM ed WHERE source NOT LIKE '%3' AND target NOT LIKE '%3'
      AND source IN (SELECT unique_name FROM nd WHERE code_hash % 5 <> 0) AND target IN (SELECT unique_name FROM nd WHERE code_hash % 5 <> 0)"""),
    "relations_inserted": f"WITH {GIVEN} SELECT * FROM given",
    "multiplicity_lines": f"""WITH {GIVEN}, top AS (SELECT source, target, max(ROW(strength, association, multiplicity)) AS t FROM given GROUP BY ALL),
      both_ AS (SELECT f.source, f.target, f.t[2] AS a, f.t[1] AS sa, f.t[3] AS ma, coalesce(r.t[2], 'NONE') AS b, coalesce(r.t[1], -1) AS sb, coalesce(r.t[3], '') AS mb FROM top f LEFT JOIN top r ON r.source = f.target AND r.target = f.source)
      SELECT source, target, '"' || source || '" ' || {_times("mb")} || {_end("a", "b", "backward")}
      || CASE WHEN sa > sb THEN {_body("a", "CASE source WHEN 'P7' THEN '#00cc00' ELSE '#464646' END")} ELSE {_body("b", "'#464646'")} END
      || {_end("b", "a", "forward")} || {_times("ma")} || '"' || target || '" ' || chr(10) AS line FROM both_""",
    "relations_described": sql("SELECT source || ' -[' || association || ' ' || strength || ']-> ' || target AS line FROM n_e"),
    "relations_distinct": sql("SELECT DISTINCT source, target, association FROM n_e"),
    "relations_out_of_added": sql("SELECT * FROM n_s WHERE source IN (SELECT unique_name FROM cc WHERE change = 'added')"),
    "interfaces_of_key_relations": sql("SELECT unique_name FROM kr WHERE unique_name IN (SELECT unique_name FROM g_c WHERE component_type = 'INTERFACE')"),
    "changes_without_base": sql("SELECT DISTINCT unique_name FROM chg WHERE unique_name NOT IN (SELECT unique_name FROM n_b WHERE base IS NOT NULL)"),
    "groups_by_type": sql("SELECT component_type AS type, count(*) AS size, string_agg(unique_name, ',' ORDER BY unique_name) AS members FROM nd GROUP BY 1"),
    "groups_condensed": sql("SELECT 'all' AS type, count(*) AS size FROM nd HAVING count(*) > 0"),
    "diagram_summary_condensed": sql("SELECT 'all' AS diagram, string_agg(DISTINCT pkg, ',' ORDER BY pkg) AS packages, count(*) AS size, count(*) <= 10 AS drawn FROM nd HAVING count(*) > 0"),
    "nodes_with_default_color": sql("SELECT unique_name, pkg AS package_path, CASE color WHEN '#f0f8ff' THEN '#E0E0E0' ELSE color END AS color FROM nd JOIN colors ON pkg = package_path"),
    "source_files_parsed": f"""WITH f AS ({FILES} WHERE doc_id % 3 < 2)
      SELECT path AS unique_name, 'CLASS' AS component_type, length(content) AS code_hash, path AS base, NULL AS parent, NULL AS place FROM f
      UNION ALL SELECT path || '.size', 'FIELD', length(content), path, path, 0 FROM f""",
    "files_of_language": f"SELECT path FROM ({FILES}) WHERE path LIKE '%.py'",
    "component_json": sql(f"SELECT unique_name, CAST(to_json({COMPONENT}) AS VARCHAR) AS json FROM nd LEFT JOIN ({REFS}) USING (unique_name)"),
    "relation_json": sql(f"SELECT source, target, strength, CAST(to_json({RELATION}) AS VARCHAR) AS json FROM ed"),
    "change_set_json": sql(f"SELECT CAST(to_json({CHANGE_SET}) AS VARCHAR) AS json"),
    "diagram_json": sql(f"""SELECT CAST(to_json({{'packages': (SELECT list_sort(list(DISTINCT pkg)) FROM nd), 'size': (SELECT count(*) FROM nd),
      'components': (SELECT list(c ORDER BY c.uniqueName) FROM (SELECT {COMPONENT} AS c FROM nd LEFT JOIN ({REFS}) USING (unique_name))),
      'relations': (SELECT map_from_entries(list((source, l) ORDER BY source)) FROM (SELECT source, list({RELATION} ORDER BY strength, target) AS l FROM ed GROUP BY source)),
      'changeSet': {CHANGE_SET}, 'compressedSVG': NULL}}) AS VARCHAR) AS json WHERE EXISTS (SELECT 1 FROM nd)"""),
    "files_filter_missing": f"SELECT path FROM ({FILES}) WHERE doc_id % 2 <> 0 AND doc_id % 3 <> 0",
    "compile_warnings": f"SELECT path FROM ({FILES}) WHERE content LIKE '%#%'",
    "text_comment_stripped": "SELECT doc_id, replace(replace(replace('/** ' || text || ' */', '/*', ''), '*/', ''), '*', '') AS text FROM documents",
    "text_brackets": "SELECT doc_id, translate(text, '()', '[]') AS text FROM documents",
    "text_normalized": r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\f\r]+', ' ', 'g')) AS text FROM documents",
    "text_wrapped": f"SELECT doc_id, {WRAPPED} AS text FROM documents",
    "text_bolded": f"SELECT doc_id, list_aggregate(list_transform(string_split({WRAPPED}, chr(10)), lambda x: '**' || x || '**'), 'string_agg', chr(10)) AS text FROM documents",
    "text_truncated": "SELECT doc_id, CASE WHEN text = '' THEN text WHEN length(text) < 800 THEN text || chr(10) ELSE trim(substring(text, 1, 797)) || '...' || chr(10) END AS text FROM documents",
    "compressed_text": "SELECT doc_id, text FROM documents",
}
