"""Queries over the tables of scanner findings."""

from __future__ import annotations

from quernstone.operators import findings
from quernstone.queries import query

_T = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
# a JSON text, or a JSON text within a JSON text
_OPEN = "CASE WHEN json_type({0}) = 'VARCHAR' THEN CASE WHEN json_valid({0} ->> '$') THEN CAST({0} ->> '$' AS JSON) END ELSE {0} END"


def _last(table: str) -> str:
    return f"(SELECT * FROM {table} WHERE rec_id IS NOT NULL QUALIFY ingested_at = max(ingested_at) OVER (PARTITION BY rec_id) OR max(ingested_at) OVER (PARTITION BY rec_id) IS NULL)"


_P2_SQL = f"""
WITH ins AS {_last('inspector')}, dep AS {_last('dependabot')}, gen AS {_last('generic')},
i1 AS (SELECT rec_id, unnest(packageVulnerabilityDetails.vulnerablePackages).name AS name, generate_subscripts(packageVulnerabilityDetails.vulnerablePackages, 1) - 1 AS pos FROM ins),
ip AS (SELECT rec_id, CAST(payload AS JSON) AS j FROM ins WHERE packageVulnerabilityDetails IS NULL AND json_valid(payload)),
id AS (SELECT rec_id, coalesce(j -> '$.packageVulnerabilityDetails', j -> '$.package_vulnerability_details', j -> '$.vulnerabilityDetails') AS d FROM ip),
io AS (SELECT rec_id, {_OPEN.format('d')} AS d FROM id WHERE d IS NOT NULL),
il AS (SELECT rec_id, coalesce(d -> '$.vulnerablePackages', d -> '$.vulnerable_packages', d -> '$.packages', json_array(d -> '$.package')) AS l FROM io),
i2 AS (SELECT rec_id, unnest(CAST(l AS JSON[])) AS p, generate_subscripts(CAST(l AS JSON[]), 1) - 1 AS pos FROM il WHERE json_type(l) = 'ARRAY'),
dp AS (SELECT rec_id, CAST(payload AS JSON) AS j FROM dep WHERE security_vulnerability IS NULL AND dependency IS NULL AND json_valid(payload)),
du AS (SELECT rec_id, coalesce(j -> '$.alerts[0]', CAST(j ->> '$.body' AS JSON), j) AS j FROM dp),
gp AS (SELECT rec_id, coalesce(CAST(payload AS JSON) -> '$.record', CAST(payload AS JSON)) -> '$.package' AS p FROM gen WHERE package IS NULL AND json_valid(payload)),
a AS (SELECT 'inspector' AS source, rec_id, 'vulnerablepackages' AS place, pos, name FROM i1 UNION ALL SELECT 'inspector', rec_id, 'vulnerablepackages', pos, coalesce(p ->> '$.name', p ->> '$.packageName') FROM i2
UNION ALL SELECT 'dependabot', rec_id, 'security_vulnerability', 0, security_vulnerability.package.name FROM dep UNION ALL SELECT 'dependabot', rec_id, 'dependency', 0, dependency.package.name FROM dep
UNION ALL SELECT 'dependabot', rec_id, 'security_vulnerability', 0, coalesce(j ->> '$.security_vulnerability.package.name', j ->> '$.securityVulnerability.package.name') FROM du
UNION ALL SELECT 'dependabot', rec_id, 'dependency', 0, j ->> '$.dependency.package.name' FROM du
UNION ALL SELECT 'generic', rec_id, 'package', 0, package.name FROM gen UNION ALL SELECT 'generic', rec_id, 'package', 0, ({_OPEN.format('p')}) ->> '$.name' FROM gp)
SELECT DISTINCT source, rec_id, place, CAST(pos AS BIGINT) AS pos, {_T.format('name')} AS name FROM a WHERE {_T.format('name')} <> ''
"""

query(findings.p2_found, sql=_P2_SQL)
query(findings.p2_objects)

_STRUCT_ROWS = """
SELECT DISTINCT 'inspector' AS source, rec_id, packageVulnerabilityDetails.vulnerabilityId AS v, severity AS s, packageVulnerabilityDetails.severity AS s2, title AS title, ingested_at FROM inspector
UNION ALL SELECT DISTINCT 'dependabot', rec_id, coalesce(security_advisory.cve_id, security_advisory.ghsa_id), security_advisory.severity, NULL, security_advisory.summary, ingested_at FROM dependabot
UNION ALL SELECT DISTINCT 'generic', rec_id, vuln.vulnId, vuln.severity, NULL, vuln.title, ingested_at FROM generic
"""


@query(sql=f"""
WITH r AS ({_STRUCT_ROWS}),
l AS (SELECT *, max(ingested_at) OVER (PARTITION BY source, rec_id) AS last FROM r WHERE rec_id IS NOT NULL),
k AS (SELECT *, lower(trim(coalesce(s, s2))) AS x FROM l WHERE ingested_at = last OR last IS NULL)
SELECT DISTINCT source, rec_id, coalesce(v, CASE WHEN source = 'inspector' THEN title END) AS vuln_id,
  CASE WHEN x IN ('critical', 'crit', 'severe') THEN 'critical' WHEN x IN ('high', 'important') THEN 'high'
       WHEN x IN ('medium', 'moderate', 'med') THEN 'medium' WHEN x IN ('low', 'minor', 'informational', 'info') THEN 'low' END AS severity,
  title FROM k
""")
def p2_records(spark, sf_dir):
    return findings.finding_records(spark, sf_dir)
