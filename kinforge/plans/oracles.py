"""DuckDB SQL for the named queries, each by a route of its own."""

from kinforge.plans import chronicle, imports, listings, rendered

SQL = {
    "surnames": "SELECT DISTINCT c_mktsegment AS surname, lower(c_mktsegment) AS sort_key FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "surname_place": """
        WITH p AS (SELECT c_mktsegment AS surname, c_custkey, n_name, CASE WHEN c_custkey % 4 = 0 THEN 9999 ELSE 1850 + c_custkey % 100 END AS y FROM customer JOIN nation ON c_nationkey = n_nationkey)
        SELECT surname, count(*) AS members, arg_min(n_name, y * 100000000 + c_custkey) AS place FROM p GROUP BY surname""",
    "person_lookup": "SELECT '@I' || c_custkey || '@' AS ptr, c_mktsegment AS surname, '1873' AS birth_date FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 100 = 23",
    "person_pointer": "SELECT '@I42@' AS ptr, c_mktsegment AS surname, n_name AS place FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 42",
    "family_rows": """
        SELECT '@F' || o_orderkey || '@' AS ptr, 'C' || a.c_custkey || ' /' || a.c_mktsegment || '/' AS husband, 'C' || b.c_custkey || ' /' || b.c_mktsegment || '/' AS wife, upper(strftime(o_orderdate, '%-d %b %Y')) AS marriage_date
        FROM orders LEFT JOIN customer a ON o_custkey = a.c_custkey LEFT JOIN customer b ON b.c_custkey = o_orderkey % 97 + 1""",
    "duplicate_persons": """
        WITH p AS (SELECT '@I' || c_custkey || '@' AS ptr, c_mktsegment AS s, c_custkey % 100 AS b FROM customer WHERE c_custkey % 4 <> 0)
        SELECT ptr, m AS master FROM (SELECT ptr, min(ptr) OVER w AS m, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY s, b)) WHERE n > 1""",
    "date_norm": """
        WITH o AS (SELECT o_orderkey, o_orderdate AS t, o_orderkey % 26 AS k, year(o_orderdate)::VARCHAR AS y, (year(o_orderdate) + 1)::VARCHAR AS z, day(o_orderdate)::VARCHAR AS d, upper(strftime(o_orderdate, '%b')) AS m,
          list_extract(['Januarii', 'Februarii', 'Martii', 'aprilis', 'maii', 'iunii', 'iulii', 'Augusti', 'Septembris', 'Octobris', 'Novembris', 'Decembris'], month(o_orderdate)) AS l FROM orders)
        SELECT o_orderkey,
          CASE k WHEN 0 THEN strftime(t, '%d.%m.%Y') WHEN 1 THEN strftime(t, '%Y-%m-%d') WHEN 2 THEN strftime(t, '%b %Y') WHEN 3 THEN '~' || y WHEN 4 THEN y || '?' WHEN 5 THEN '__.__.' || y WHEN 6 THEN 'FROM ' || y || ' TO ' || z WHEN 7 THEN 'before ' || y WHEN 8 THEN '  ' || y || '. ' WHEN 9 THEN '?'
            WHEN 10 THEN 'OD ' || y WHEN 11 THEN y || '/7' WHEN 12 THEN y || '-1' WHEN 13 THEN d || ' ' || l || ' ' || y WHEN 14 THEN y || ' DO ' || z WHEN 15 THEN 'MED ' || y || ' - ' || z WHEN 16 THEN 'between ' || y || ' and ' || z WHEN 17 THEN strftime(t, '.%m.%Y') WHEN 18 THEN '17.3.' || left(y, 3) || 'x'
            WHEN 19 THEN d || '. Foo ' || y WHEN 20 THEN '15 7bris ' || y WHEN 21 THEN 'Prred ' || y WHEN 22 THEN '(' || y || ')' WHEN 23 THEN strftime(t, '%d.%m.%Y') || '   7' WHEN 24 THEN '25.13.' || y ELSE 'nobody knows' END AS raw,
          CASE WHEN k IN (0, 1, 13, 23) THEN d || ' ' || m || ' ' || y WHEN k IN (2, 17) THEN m || ' ' || y WHEN k IN (3, 4, 19) THEN 'ABT ' || y WHEN k IN (5, 8, 12, 22, 24) THEN y WHEN k IN (6, 14, 15) THEN 'FROM ' || y || ' TO ' || z WHEN k IN (7, 21) THEN 'BEF ' || y WHEN k = 9 THEN '' WHEN k = 10 THEN 'FROM ' || y WHEN k = 11 THEN y || '/7'
            WHEN k = 16 THEN 'BET ' || y || ' AND ' || z WHEN k = 18 THEN 'ABT 17 MAR ' || left(y, 3) || '0' WHEN k = 20 THEN '15 SEP ' || y END AS value,
          k = 25 AS warned FROM o""",
    "date_sort_topk": "SELECT o_orderkey, day(o_orderdate) || ' ' || upper(strftime(o_orderdate, '%b')) || ' ' || year(o_orderdate) AS canonical FROM orders ORDER BY o_orderdate::DATE, o_orderkey LIMIT 50",
    "year_partial": "SELECT o_orderkey, (year(o_orderdate) // 10) * 10 + 9 AS birth_year FROM orders",
    "year_extractors": """
        WITH e AS (SELECT event_id, (event_id % 4000)::INT AS n FROM events)
        SELECT event_id, CASE WHEN n BETWEEN 1000 AND 2029 THEN n END AS strict, CASE WHEN n BETWEEN 1000 AND 2099 THEN n END AS query, CASE WHEN n >= 100 THEN n END AS loose, CASE WHEN n >= 1000 THEN n END AS four FROM e""",
    "date_compact": """
        SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN day(o_orderdate) || ' ' || upper(strftime(o_orderdate, '%b')) || ' ' || year(o_orderdate) WHEN 1 THEN upper(strftime(o_orderdate, '%b %Y')) ELSE year(o_orderdate)::VARCHAR END AS value FROM orders""",
    "date_slovenian": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN day(o_orderdate) || ' ' ELSE '' END || upper(strftime(o_orderdate, '%b %Y')) AS value FROM orders",
    "name_placeholder": """
        WITH p AS (SELECT c_custkey, c_custkey % 5 < 4 AS no_given, c_custkey % 3 AS s, c_mktsegment AS m FROM customer)
        SELECT c_custkey, CASE WHEN no_given AND s < 2 THEN 'NN' ELSE (CASE WHEN no_given THEN 'NN' ELSE 'Ana' END) || ' /' || (CASE WHEN s < 2 THEN 'NN' ELSE m END) || '/' END AS name FROM p""",
    "name_capitals": """
        WITH w AS (SELECT p_partkey, p_partkey % 6 AS k, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
        t AS (SELECT p_partkey, k, a, b, upper(a[1]) || lower(a[2:]) AS c, upper(b[1]) || lower(b[2:]) AS d FROM w)
        SELECT p_partkey, CASE k WHEN 0 THEN c || '-' || d WHEN 1 THEN c || ' ' || d WHEN 2 THEN c || ' von der ' || d WHEN 3 THEN 'NN /De ' || d || '/' WHEN 4 THEN c || ' (' || b || ') /Mc' || d || '/' ELSE 'V. ' || c || ' v. /NN/' END AS title,
          CASE k WHEN 0 THEN c || '-' || d WHEN 1 THEN a || ' ' || b WHEN 2 THEN c || ' von der ' || d WHEN 3 THEN 'nn /de ' || upper(b) || '/' WHEN 4 THEN upper(a) || ' (' || b || ') /Mc' || d || '/' ELSE 'V. ' || c || ' v. /NN/' END AS lowered FROM t""",
    "name_initials": """
        WITH w AS (SELECT p_partkey, upper(split_part(p_name, ' ', 1)[1]) AS a, upper(split_part(p_name, ' ', 2)[1]) AS b, split_part(p_name, ' ', 2) AS s FROM part)
        SELECT p_partkey, a || '. ' || b || '.' AS initials, a || '. /' || b || './' AS short, a || '. /' || s || '/' AS given_short FROM w""",
    "name_split": "SELECT c_custkey, c_name || ' jr.' AS given, c_mktsegment AS surname FROM customer",
    "place_duplicates": "SELECT c_custkey, c_name || ', ' || n_name || ', ' || r_name AS place FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "place_ends": "SELECT c_custkey, c_name || ', ' || r_name AS place FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "place_country": "SELECT c_custkey, c_name AS place FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "place_placeholder": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE n_name END AS place FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "make_id": "SELECT c_custkey, left(md5(c_name || chr(31) || c_mktsegment), 8) AS id FROM customer",
    "tree_parents": """
        WITH i AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS f, max(l_linestatus) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
        SELECT o_orderkey * 1000 + 1 AS no, 1 AS level, 'NAME' AS tag, o_orderstatus AS value, 'INDI' AS parent_tag, '' AS parent_value, 'INDI' AS rec_tag FROM orders
        UNION ALL SELECT l_orderkey * 1000 + l_linenumber * 10, 1, 'EVEN', l_linenumber::VARCHAR, 'INDI', '', 'INDI' FROM i
        UNION ALL SELECT l_orderkey * 1000 + l_linenumber * 10 + 1, 2, 'TYPE', f, 'EVEN', l_linenumber::VARCHAR, 'INDI' FROM i
        UNION ALL SELECT l_orderkey * 1000 + l_linenumber * 10 + 2, 2, 'CHAN', s, 'EVEN', l_linenumber::VARCHAR, 'INDI' FROM i""",
    "strip_subtree": "SELECT o_orderkey * 1000 AS no, 'INDI' AS tag, '' AS value FROM orders UNION ALL SELECT o_orderkey * 1000 + 1, 'NAME', o_orderstatus FROM orders",
    "strip_level": """
        WITH i AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT 'INDI' AS tag, 0 AS level, count(*) AS n FROM orders UNION ALL SELECT 'NAME', 1, count(*) FROM orders UNION ALL SELECT 'EVEN', 1, count(*) FROM i UNION ALL SELECT 'TYPE', 2, count(*) FROM i""",
    "tag_rename": """
        WITH i AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS f, max(l_linestatus) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
        SELECT 0 AS level, 'INDI' AS tag, '' AS value, count(*) AS n FROM orders
        UNION ALL SELECT 1, 'NAME', o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus
        UNION ALL SELECT 1, 'FACT', l_linenumber::VARCHAR, count(*) FROM i GROUP BY l_linenumber
        UNION ALL SELECT 2, 'TYPE', 'Shipment', count(*) FROM i
        UNION ALL SELECT 2, 'TYPE', f, count(*) FROM i GROUP BY f
        UNION ALL SELECT 2, 'CHAN', s, count(*) FROM i GROUP BY s""",
    "address_to_place": "SELECT 'INDI' AS rec_tag, 2 AS level, 'PLAC' AS tag, n_name || ' ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ', Europe' ELSE '' END AS value FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "tree_text": """
        WITH i AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS f, max(l_linestatus) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
        x AS (SELECT o_orderkey * 1000 AS no, '0 @O' || o_orderkey || '@ INDI' AS line FROM orders UNION ALL SELECT o_orderkey * 1000 + 1, '1 NAME ' || o_orderstatus FROM orders
        UNION ALL SELECT l_orderkey * 1000 + l_linenumber * 10, '1 EVEN ' || l_linenumber FROM i UNION ALL SELECT l_orderkey * 1000 + l_linenumber * 10 + 1, '2 TYPE ' || f FROM i UNION ALL SELECT l_orderkey * 1000 + l_linenumber * 10 + 2, '2 CHAN ' || s FROM i)
        SELECT 'f' || (no // 100000) AS file, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY no) || chr(10)) AS digest FROM x GROUP BY 1""",
    "cleaner_changes": """
        WITH i AS (SELECT DISTINCT l_orderkey // 100 AS f, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT f, count(*) AS c FROM i GROUP BY f), o AS (SELECT o_orderkey // 100 AS f, count(*) AS c FROM orders GROUP BY 1)
        SELECT 'f' || o.f AS file, 2 * o.c + 3 * coalesce(n.c, 0) AS processed, coalesce(n.c, 0) AS changed, coalesce(n.c, 0) AS removed FROM o LEFT JOIN n USING (f)""",
    "stat_counts": "SELECT 'INDI' AS label, count(*) AS n FROM orders UNION ALL SELECT unnest(['FAM', 'SOUR', 'REPO', 'OBJE', 'NOTE', 'SUBM']), 0",
    "ancestors": """
        WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS c, unnest([c_custkey // 2, c_custkey // 3]) AS p FROM customer WHERE c_custkey > 1),
        a(id, depth) AS (SELECT 97, 0 UNION SELECT p, depth + 1 FROM a JOIN e ON c = id WHERE p > 0)
        SELECT id::BIGINT AS id, min(depth)::INT AS depth FROM a GROUP BY id""",
    "descendants": """
        WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS c, unnest([c_custkey // 2, c_custkey // 3]) AS p FROM customer WHERE c_custkey > 1),
        a(id, depth) AS (SELECT 5, 0 UNION SELECT c, depth + 1 FROM a JOIN e ON p = id WHERE p > 0)
        SELECT id::BIGINT AS id, min(depth)::INT AS depth FROM a GROUP BY id""",
    "bloodline": """
        WITH RECURSIVE x AS (SELECT c_custkey AS c, c_custkey % 10 AS r, c_custkey // 10 AS q FROM customer WHERE c_custkey >= 10),
        e AS (SELECT * FROM (SELECT DISTINCT c, unnest([q // 2 * 10 + r, q // 3 * 10 + r]) AS p FROM x) WHERE p > 0),
        u(id) AS (SELECT 111::BIGINT UNION SELECT p FROM u JOIN e ON c = id), d(id) AS (SELECT id FROM u UNION SELECT c FROM d JOIN e ON p = id)
        SELECT id FROM d""",
    "siblings": """
        WITH e AS (SELECT DISTINCT c_custkey AS c, unnest([c_custkey // 2, c_custkey // 3]) AS p FROM customer WHERE c_custkey > 1)
        SELECT DISTINCT b.c AS id FROM e a JOIN e b USING (p) WHERE a.c = 25 AND b.c <> 25 AND p > 0""",
    "partners": """
        WITH s AS (SELECT o_orderkey AS f, o_custkey AS a, o_orderkey % 97 + 1 AS b FROM orders)
        SELECT DISTINCT CASE WHEN a = 7 THEN b ELSE a END AS id FROM s WHERE (a = 7) <> (b = 7)""",
    "filter_cleanup": """
        WITH RECURSIVE k AS (SELECT c_custkey AS c, c_custkey // 2 AS h, CASE WHEN c_custkey // 3 > 0 AND c_custkey // 3 <> c_custkey // 2 THEN c_custkey // 3 END AS w, (c_custkey // 2) || '_' || (c_custkey // 3) AS f FROM customer WHERE c_custkey > 1),
        e AS (SELECT c, h AS p, f FROM k UNION SELECT c, w, f FROM k WHERE w IS NOT NULL),
        d(id) AS (SELECT 3::BIGINT UNION SELECT c FROM d JOIN e ON p = id), g AS (SELECT DISTINCT f FROM k WHERE c IN (FROM d) OR h IN (FROM d) OR w IN (FROM d))
        SELECT '@I' || c || '@' AS owner, 'FAMC' AS tag, '@F' || f || '@' AS value FROM k WHERE c IN (FROM d)
        UNION ALL SELECT DISTINCT '@I' || p || '@', 'FAMS', '@F' || f || '@' FROM e WHERE p IN (FROM d)
        UNION ALL SELECT DISTINCT '@F' || f || '@', 'HUSB', '@I' || h || '@' FROM k WHERE h IN (FROM d)
        UNION ALL SELECT DISTINCT '@F' || f || '@', 'WIFE', '@I' || w || '@' FROM k WHERE w IN (FROM d)
        UNION ALL SELECT '@F' || f || '@', 'CHIL', '@I' || c || '@' FROM k WHERE c IN (FROM d)""",
    "filter_expand": """
        WITH RECURSIVE k AS (SELECT c_custkey AS c, c_custkey // 2 AS h, CASE WHEN c_custkey // 3 > 0 AND c_custkey // 3 <> c_custkey // 2 THEN c_custkey // 3 END AS w, (c_custkey // 2) || '_' || (c_custkey // 3) AS f FROM customer WHERE c_custkey > 1),
        e AS (SELECT c, h AS p, f FROM k UNION SELECT c, w, f FROM k WHERE w IS NOT NULL),
        z(r, id) AS (SELECT unnest([97, 64])::BIGINT, unnest([97, 64])::BIGINT UNION SELECT r, c FROM z JOIN e ON p = id), bad AS (SELECT id FROM z WHERE id NOT IN (97, 64)),
        a(id) AS (SELECT unnest([97, 64])::BIGINT UNION SELECT p FROM a JOIN e ON c = id WHERE p NOT IN (FROM bad)),
        s AS (SELECT id FROM a UNION SELECT c FROM k WHERE f IN (SELECT f FROM k WHERE c IN (FROM a)) AND c NOT IN (FROM bad)),
        n AS (SELECT f FROM e WHERE p IN (FROM s) UNION SELECT f FROM k WHERE c IN (FROM s))
        SELECT '@I' || id || '@' AS id FROM (FROM s UNION SELECT p FROM e WHERE f IN (FROM n) AND p NOT IN (FROM bad))""",
    "filter_related": """
        WITH RECURSIVE k AS (SELECT c_custkey AS c, c_custkey // 2 AS h, CASE WHEN c_custkey // 3 > 0 AND c_custkey // 3 <> c_custkey // 2 THEN c_custkey // 3 END AS w, (c_custkey // 2) || '_' || (c_custkey // 3) AS f FROM customer WHERE c_custkey > 1),
        e AS (SELECT c, h AS p, f FROM k UNION SELECT c, w, f FROM k WHERE w IS NOT NULL),
        u(id) AS (SELECT 7::BIGINT UNION SELECT p FROM u JOIN e ON c = id), bad AS (SELECT id FROM u WHERE id <> 7),
        d(id) AS (SELECT 7::BIGINT UNION SELECT c FROM d JOIN e ON p = id WHERE c NOT IN (FROM bad)),
        s AS (SELECT DISTINCT p AS id FROM e WHERE f IN (SELECT f FROM e WHERE p IN (FROM d)) AND p NOT IN (FROM d) AND p NOT IN (FROM bad)),
        b AS (SELECT DISTINCT f FROM k WHERE c IN (FROM s)),
        r AS (FROM d UNION FROM s UNION SELECT c FROM k WHERE f IN (FROM b) AND c NOT IN (FROM bad) UNION SELECT p FROM e WHERE f IN (FROM b) AND p NOT IN (FROM bad)),
        r2(id) AS (FROM r UNION SELECT c FROM r2 JOIN e ON p = id WHERE c NOT IN (FROM bad)),
        n AS (SELECT f FROM e WHERE p IN (FROM r2) UNION FROM b),
        t AS (FROM r2 UNION SELECT p FROM e WHERE f IN (FROM n) AND p NOT IN (FROM bad))
        SELECT unnest(['@I7@', 'TOTAL']) AS id, count(*) AS persons FROM t""",
    "surname_origins": """
        WITH RECURSIVE x AS (SELECT c_custkey AS id, CASE WHEN c_mktsegment < 'C' THEN 'A' ELSE 'B' END AS s, CASE WHEN c_custkey % 7 = 0 THEN n_name ELSE '' END AS place FROM customer JOIN nation ON c_nationkey = n_nationkey),
        e AS (SELECT * FROM (SELECT DISTINCT c_custkey AS c, unnest([c_custkey // 2, c_custkey // 3]) AS p FROM customer WHERE c_custkey > 1) WHERE p > 0),
        walk(who, id, s, place, depth) AS (SELECT id, id, s, place, 0 FROM x UNION SELECT who, x.id, x.s, x.place, depth + 1 FROM walk JOIN e ON c = walk.id JOIN x ON x.id = p AND x.s = walk.s WHERE walk.place = ''),
        best AS (SELECT who, arg_min(place, (depth, id)) AS place FROM walk WHERE place <> '' GROUP BY who)
        SELECT x.id, coalesce(best.place, '') AS place FROM x LEFT JOIN best ON who = x.id""",
    "private_born": """SELECT '@O' || o_orderkey || '@' AS ptr FROM orders WHERE o_orderkey % 9 <> 0 AND year(o_orderdate) - 60 - o_orderkey % 90 > 1925""",
    "private_died": """
        SELECT '@O' || o_orderkey || '@' AS ptr FROM orders WHERE (o_orderkey % 4 = 0 AND 2000 - (year(o_orderdate) - o_orderkey % 40) < 20) OR (o_orderkey % 4 = 1 AND o_orderkey % 9 <> 0 AND 2000 - (year(o_orderdate) - 60 - o_orderkey % 90) < 20)""",
    "strip_living": """SELECT '@O' || o_orderkey || '@' AS ptr FROM orders WHERE o_orderkey % 4 >= 2 AND (o_orderkey % 9 = 0 OR year(o_orderdate) - 60 - o_orderkey % 90 > 1890)""",
    "private_families": """
        WITH f AS (SELECT c_custkey AS c, c_custkey % 3 = 0 AS a, (c_custkey // 2) % 3 = 0 AS b FROM customer)
        SELECT '@F' || c || '@' AS family, CASE WHEN a OR b THEN '<private>' ELSE 'Y' END AS marriage FROM f WHERE NOT (a AND b)""",
    "link_domains": """
        WITH l AS (SELECT page_id, CASE WHEN href[1] = '/' THEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') || href ELSE href END AS url FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages)), h AS (SELECT page_id, lower(split_part(split_part(url, '://', 2), '/', 1)) AS h FROM l), d AS (SELECT page_id, CASE WHEN contains(h, '.') THEN array_to_string(string_split(h, '.')[-2:], '.') ELSE h END AS k FROM h)
        SELECT k AS link_key, count(*) AS n, min(page_id) AS first FROM d GROUP BY k ORDER BY n DESC, first LIMIT 10""",
    "link_paths": """
        WITH l AS (SELECT page_id, CASE WHEN href[1] = '/' THEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') || href ELSE href END AS url FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages)), p AS (SELECT url, split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1) AS r FROM l)
        SELECT lower(split_part(r, '/', 1)) || CASE WHEN split_part(r, '/', 2) <> '' THEN '/' || split_part(r, '/', 2) ELSE '' END AS link_key, count(*) AS n, min(url) AS first FROM p GROUP BY 1 ORDER BY n DESC, first LIMIT 20""",
    "url_search": """WITH l AS (SELECT page_id, CASE WHEN href[1] = '/' THEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') || href ELSE href END AS url FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages)) SELECT DISTINCT '@P' || page_id || '@' AS pointer, regexp_extract(url, '^[^\\s<>''"]+') AS url FROM l WHERE contains(lower(regexp_extract(url, '^[^\\s<>''"]+')), '/de')""",
    "duplicate_urls": """
        WITH l AS (SELECT page_id, CASE WHEN href[1] = '/' THEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') || href ELSE href END AS url FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages)), d AS (SELECT DISTINCT rtrim(lower(url), '/') AS url_key, page_id AS owner FROM l)
        SELECT url_key, owner, n FROM (SELECT url_key, owner, count(*) OVER (PARTITION BY url_key) AS n FROM d) WHERE n > 1""",
    "link_audit": """
        WITH l AS (SELECT page_id, CASE WHEN href[1] = '/' THEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') || href ELSE href END AS url FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages)), p AS (SELECT url, rtrim(lower(url), '/') AS k, 'p' || (page_id % 3) AS label FROM l), listed AS (SELECT rtrim(lower(url), '/') AS k FROM pages UNION SELECT k FROM p WHERE label = 'p0')
        SELECT min(url) AS url, string_agg(DISTINCT label, ', ' ORDER BY label) AS labels FROM p WHERE k NOT IN (FROM listed) GROUP BY k""",
    "merge_pointers": """
        SELECT 0 AS level, 'INDI' AS tag, '@f1_N' || n_nationkey || '@' AS pointer, '' AS value FROM nation UNION ALL SELECT 1, 'NAME', '', n_name FROM nation
        UNION ALL SELECT 0, 'INDI', '@f2_N' || r_regionkey || '@', '' FROM region UNION ALL SELECT 1, 'NAME', '', '@f2_N' || r_regionkey || '@' FROM region UNION ALL SELECT 0, 'TRLR', '', ''""",
    "dedupe_groups": """
        SELECT c_custkey, m AS master, n FROM (SELECT c_custkey, min(c_custkey::VARCHAR) OVER w AS m, count(*) OVER w AS n FROM customer WINDOW w AS (PARTITION BY c_mktsegment, c_nationkey, floor(c_acctbal / 100))) WHERE n > 1""",
    "metadata_upsert": """SELECT n_nationkey::BIGINT AS contributor, n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name FROM supplier""",
    "incremental_skip": "SELECT user_id FROM events GROUP BY user_id HAVING max(ts) > coalesce(max(ts) FILTER (event_id % 2 = 0), TIMESTAMP '1900-01-01')",
    "grave_stats": "SELECT p_type, count(*) AS persons, count(DISTINCT l_orderkey) AS graves, min(p_partkey) AS first_part FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type",
    "rollup_total": """
        SELECT o_orderpriority AS file, o_orderstatus AS processor, count(*) AS n FROM orders GROUP BY 1, 2 UNION ALL SELECT o_orderpriority, 'TOTAL', count(*) FROM orders GROUP BY 1 UNION ALL SELECT 'TOTAL', 'TOTAL', count(*) FROM orders""",
}

SQL |= imports.SQL | rendered.SQL | chronicle.SQL | listings.SQL
