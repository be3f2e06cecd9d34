"""DuckDB SQL for every query whose result plain SQL can state independently."""

from oracle_views import ATOMS, BONDED, POS, RUNS

O: dict[str, str] = {}


def W(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes) + "\n"


def pairs(name: str, left: str, right: str, src: str = "pos") -> str:
    """All pairs of a frame with their minimum image in the cubic box; no grid."""
    d = {n: f"(b.{n}-a.{n}-20*round_even((b.{n}-a.{n})/20,0))" for n in "xyz"}
    return f"""{name} AS (SELECT traj, frame, i, j, dx, dy, dz, dx*dx+dy*dy+dz*dz AS r2 FROM (
  SELECT a.traj, a.frame, a.atom_id AS i, b.atom_id AS j, {d['x']} AS dx, {d['y']} AS dy, {d['z']} AS dz
  FROM {src} a JOIN {src} b ON a.traj=b.traj AND a.frame=b.frame AND a.atom_id<>b.atom_id
  WHERE a.site IN {left} AND b.site IN {right}))"""


PI43 = "(4.0::DOUBLE/3.0*pi())"
TRAJS = "trajs AS (SELECT DISTINCT traj FROM pos)"


def grid(bins: int) -> str:
    return f"grid AS (SELECT traj, CAST(b AS INT) AS bin FROM trajs, RANGE({bins}) t(b))"


def rdf_tail(bw: float, bins: int, weight: str, norms: str, extra: str = "", rmax: float = 6.0) -> str:
    lo, hi = f"(bin*{bw}::DOUBLE)", f"((bin+1)*{bw}::DOUBLE)"
    return f"""
, {TRAJS}, {grid(bins)},
hist AS (SELECT traj, LEAST(CAST(FLOOR(SQRT(r2)/{bw}::DOUBLE) AS INT), {bins - 1}) AS bin, COUNT(*) AS c
  FROM p WHERE r2 <= {rmax * rmax} {extra} GROUP BY ALL),
norms AS ({norms}),
g AS (SELECT traj, bin, ({lo}+{hi})*0.5 AS r, COALESCE(c,0) AS count,
  COALESCE(c,0)/({weight}*{PI43}*({hi}*{hi}*{hi}-{lo}*{lo}*{lo})) AS g,
  SUM(COALESCE(c,0)) OVER (PARTITION BY traj ORDER BY bin)/tn1::DOUBLE AS cn
  FROM grid JOIN norms USING (traj) LEFT JOIN hist USING (traj, bin))
"""


def cnt(s1: str, s2: str, like: int = 0, vol: str = "8000.0") -> str:
    return f"""SELECT traj, SUM(n1*n2/v) AS pf, SUM(n1) AS tn1, AVG(n2) AS n2, AVG(v) AS mv FROM (
  SELECT traj, frame, COUNT(*) FILTER (site='{s1}') AS n1, COUNT(*) FILTER (site='{s2}')-{like} AS n2,
  {vol}::DOUBLE AS v FROM pos GROUP BY traj, frame) GROUP BY traj"""


R6 = "ROUND({0},6) AS {0}"


def r(cols: str, digits: int = 6) -> str:
    return ", ".join(f"ROUND({c},{digits})+0.0::DOUBLE AS {c}" for c in cols.split())


def frames_sql(a: str, al: str, be: str, ga: str) -> str:
    """Cell of each frame, b = c = 20."""
    return f"""
fr AS (SELECT traj, frame, {a} AS a, 20.0::DOUBLE AS b, 20.0::DOUBLE AS c,
  {al} AS al, {be} AS be, {ga} AS ga FROM (SELECT DISTINCT traj, frame FROM pos)),
ang AS (SELECT *, CASE WHEN al=90 THEN 0.0::DOUBLE ELSE COS(RADIANS(al)) END AS ca,
  CASE WHEN be=90 THEN 0.0::DOUBLE ELSE COS(RADIANS(be)) END AS cb,
  CASE WHEN ga=90 THEN 0.0::DOUBLE ELSE COS(RADIANS(ga)) END AS cg,
  CASE WHEN ga=90 THEN 1.0::DOUBLE ELSE SIN(RADIANS(ga)) END AS sg FROM fr),
cell AS (SELECT traj, frame, a, b, c, al, be, ga, a AS ax, b*cg AS bx, b*sg AS "by", c*cb AS cx, c*(ca-cb*cg)/sg AS cy,
  SQRT(c*c-c*cb*c*cb-(c*(ca-cb*cg)/sg)*(c*(ca-cb*cg)/sg)) AS cz,
  a*b*c*SQRT(1-COS(RADIANS(al))**2-COS(RADIANS(be))**2-COS(RADIANS(ga))**2
    +2*COS(RADIANS(al))*COS(RADIANS(be))*COS(RADIANS(ga))) AS v FROM ang)"""


# Triclinic cell of each frame.
FRAMES = frames_sql("20.0::DOUBLE+0.05::DOUBLE*(frame%7)", "(90-frame%5)::DOUBLE", "90.0::DOUBLE", "(90+frame%3)::DOUBLE")


def tri_min(sel: str, src: str) -> str:
    """Minimum image of (dx, dy, dz) with cell columns in scope."""
    return f"""
f1 AS (SELECT *, z0/cz AS fz FROM ({src})), f2 AS (SELECT *, (y0-fz*cy)/"by" AS fy FROM f1),
f3 AS (SELECT *, round_even((x0-fy*bx-fz*cx)/ax,0) AS kx, round_even(fy,0) AS ky, round_even(fz,0) AS kz FROM f2),
mi AS (SELECT {sel}, x0-(kx*ax+ky*bx+kz*cx) AS dx, y0-(ky*"by"+kz*cy) AS dy, z0-kz*cz AS dz FROM f3)"""


def triclinic_rdf(bw: float, bins: int, rmax: float) -> str:
    return W(POS, FRAMES, tri_min("traj, frame", """SELECT a.traj, a.frame, b.x-a.x AS x0, b.y-a.y AS y0,
  b.z-a.z AS z0, c.* EXCLUDE (traj, frame) FROM pos a JOIN pos b ON a.traj=b.traj AND a.frame=b.frame
  JOIN cell c ON c.traj=a.traj AND c.frame=a.frame WHERE a.site='Li' AND b.site='O'"""),
    "p AS (SELECT traj, frame, dx*dx+dy*dy+dz*dz AS r2 FROM mi)") + rdf_tail(bw, bins, "pf", """
  SELECT traj, SUM(n1*n2/v) AS pf, SUM(n1) AS tn1 FROM (SELECT traj, frame, COUNT(*) FILTER (site='Li') AS n1,
  COUNT(*) FILTER (site='O') AS n2 FROM pos GROUP BY traj, frame) JOIN cell USING (traj, frame) GROUP BY traj""", rmax=rmax)


O["rdf_frame_volume"] = triclinic_rdf(0.5, 12, 6.0) + f"SELECT traj, bin, count, {r('r g')} FROM g"
O["rdf_uneven_frame"] = triclinic_rdf(0.7, 9, 6.3) + f"SELECT traj, bin, count, {r('r g cn')} FROM g"
O["rdf_uneven_mean"] = W(POS, pairs("p", "('Li')", "('Li')")) + rdf_tail(
    0.7, 9, "tn1*n2/mv", cnt("Li", "Li", 1), "AND r2 > 1e-16", rmax=6.3) + f"SELECT traj, bin, count, {r('r g cn')} FROM g"
O["rdf_mean_volume"] = W(POS, pairs("p", "('Li')", "('Li')")) + rdf_tail(
    0.5, 12, "tn1*n2/mv", cnt("Li", "Li", 1), "AND r2 > 1e-16") + f"SELECT traj, bin, count, {r('r g')} FROM g"
O["rdf_cn"] = W(POS, pairs("p", "('Li')", "('O')")) + rdf_tail(
    0.5, 12, "tn1*n2/mv", cnt("Li", "O")) + f"SELECT traj, bin, count, {r('r g cn')} FROM g"

O["neighbor_pairs"] = W(POS, pairs("p", "('Li')", "('N','O','S')")) + f"""
SELECT traj, frame, i, j, {r('dx dy dz')}, ROUND(SQRT(r2),6) AS distance FROM p WHERE r2 <= 12.25"""
O["neighbor_pairs_fine"] = W(POS, pairs("p", "('Li','H')", "('N','O')")) + """
SELECT traj, frame, i, j, ROUND(SQRT(r2),6) AS distance FROM p WHERE r2 <= 1.95*1.95"""
O["neighbor_pairs_rhombic"] = W(POS, frames_sql("20.0::DOUBLE", "60.0::DOUBLE", "60.0::DOUBLE", "60.0::DOUBLE"),
    tri_min("traj, frame, i, j", """SELECT a.traj, a.frame, a.atom_id AS i, b.atom_id AS j, b.x-a.x AS x0, b.y-a.y AS y0,
  b.z-a.z AS z0, c.* EXCLUDE (traj, frame) FROM pos a JOIN pos b ON a.traj=b.traj AND a.frame=b.frame
  JOIN cell c ON c.traj=a.traj AND c.frame=a.frame WHERE a.site='Li' AND b.site IN ('N','O','S')""")) + f"""
SELECT traj, frame, i, j, {r('dx dy dz')}, ROUND(SQRT(dx*dx+dy*dy+dz*dz),6) AS distance FROM mi WHERE dx*dx+dy*dy+dz*dz <= 12.25"""
MOLP = """cand AS (SELECT traj, frame, i, (j//5)*5+1 AS mol_id, MIN(r2) AS r2 FROM p GROUP BY ALL)"""
O["contact_min_distance"] = W(POS, pairs("p", "('Li')", "('N','O','S')"), MOLP) + """
SELECT traj, frame, i, mol_id, ROUND(SQRT(r2),6) AS distance FROM cand WHERE r2 <= 25"""
ALLS = "('Li','N','O','S','H')"
O["overlap_topk"] = W(POS, pairs("p", ALLS, ALLS)) + """
SELECT traj, frame, i, j, ROUND(SQRT(r2),6) AS distance FROM p WHERE i<j AND i//5<>j//5 AND r2 <= 2.25
ORDER BY SQRT(r2), traj, frame, i, j LIMIT 20"""


def triplets(third: str, keep: str) -> str:
    return W(POS, pairs("p", "('Li')", "('N','O')"), f"""
t AS (SELECT a.traj, a.frame, a.i AS centre, DEGREES(ACOS(GREATEST(-1, LEAST(1,
  (a.dx*b.dx+a.dy*b.dy+a.dz*b.dz)/(SQRT(a.r2)*SQRT(b.r2)))))) AS ang
  FROM p a JOIN p b ON a.traj=b.traj AND a.frame=b.frame AND a.i=b.i AND {keep}
  WHERE a.j%5=2 AND b.j%5={third} AND a.r2<25 AND b.r2<25 AND a.r2>0 AND b.r2>0)""")


ADF = f"""
, {TRAJS}, {grid(18)}, h AS (SELECT traj, LEAST(CAST(FLOOR(ang/10.0::DOUBLE) AS INT),17) AS bin, COUNT(*) AS c FROM t GROUP BY ALL),
d AS (SELECT traj, bin, COALESCE(c,0) AS count, SUM(COALESCE(c,0)) OVER (PARTITION BY traj) AS tot
  FROM grid LEFT JOIN h USING (traj, bin))
SELECT traj, bin, bin*10.0::DOUBLE+5 AS angle_deg, CASE WHEN tot>0 THEN ROUND(count/(tot*10.0::DOUBLE),6) ELSE 0 END AS density_per_degree,
  CASE WHEN tot>0 THEN ROUND(count/tot::DOUBLE,6) ELSE 0 END AS probability_per_bin, count FROM d"""
O["adf"] = triplets("1", "a.j<>b.j") + ADF
O["adf_unique_terminals"] = triplets("2", "a.j<b.j") + ADF
O["adf_counters"] = triplets("1", "a.j<>b.j") + """
SELECT traj, COUNT(DISTINCT frame) AS n_frames_with_angles, COUNT(DISTINCT (frame, centre)) AS n_centers_with_angles,
  COUNT(*) AS n_angles_total FROM t GROUP BY traj"""

EVEN = """ev25 AS (SELECT DISTINCT traj, CASE WHEN i=k-1 THEN CASE WHEN k>1 THEN n-1 ELSE 0 END
  ELSE CAST(FLOOR(i*((n-1)/GREATEST(k-1,1)::DOUBLE)) AS BIGINT) END AS frame
  FROM (SELECT traj, MAX(frame)+1 AS n, LEAST(25, MAX(frame)+1) AS k FROM pos GROUP BY traj), RANGE(25) t(i) WHERE i<k)"""
O["even_frames"] = W(POS, EVEN) + "SELECT traj, frame FROM ev25"
O["rdf_sampled"] = W(POS, EVEN, "pp AS (SELECT pos.* FROM pos SEMI JOIN ev25 USING (traj, frame))",
                     pairs("p", "('Li')", "('O')", "pp")) + rdf_tail(
    0.2, 30, "pf", cnt("Li", "O").replace("FROM pos", "FROM pp")) + f"SELECT traj, bin, {r('r g')}, count FROM g"

CURVE = W(POS, pairs("p", "('Li')", "('O')")) + rdf_tail(0.2, 30, "tn1*n2/mv", cnt("Li", "O"))


def smoothed(source: str) -> str:
    return f""", taps AS (SELECT o, EXP(-0.5*(o/2.0)**2)/SUM(EXP(-0.5*(o/2.0)**2)) OVER () AS w FROM RANGE(-8,9) t(o)),
sm AS (SELECT a.traj, a.bin, a.r, a.g, SUM(w*b.g) AS smoothed FROM g a, taps JOIN g b ON b.bin={source} AND b.traj=a.traj
  GROUP BY ALL)"""


NEAREST = "GREATEST(0, LEAST(29, a.bin+o))"
REFLECT = "CASE WHEN (a.bin+o+60)%60<30 THEN (a.bin+o+60)%60 ELSE 59-(a.bin+o+60)%60 END"
O["rdf_smooth"] = CURVE + smoothed(NEAREST) + f"SELECT traj, bin, {r('r g smoothed')} FROM sm"
O["rdf_smooth_reflect"] = CURVE + smoothed(REFLECT) + f"SELECT traj, bin, {r('r g smoothed')} FROM sm"
O["first_minimum"] = CURVE + smoothed(NEAREST) + """
, n AS (SELECT traj, bin, r, smoothed AS v, LAG(smoothed) OVER w AS l, LEAD(smoothed) OVER w AS u FROM sm
  WINDOW w AS (PARTITION BY traj ORDER BY bin)),
pk AS (SELECT traj, bin, r, v, MAX(v) OVER (PARTITION BY traj) AS top FROM n WHERE v>l AND v>u AND r>=1.2),
first_pk AS (SELECT traj, MIN(r) AS rp FROM pk WHERE v>=0.1*top GROUP BY traj),
mn AS (SELECT n.traj, MIN(n.r) AS rm FROM n JOIN first_pk f USING (traj) WHERE v<l AND v<u AND n.r-rp>=0.4-1e-9 GROUP BY n.traj)
SELECT traj, ROUND(rp,6) AS r_peak, ROUND(rm,6) AS r_min, CASE WHEN rp IS NULL THEN 'no_first_shell_peak'
  WHEN rm IS NULL THEN 'no_separated_minimum' ELSE 'ok' END AS status
FROM trajs LEFT JOIN first_pk USING (traj) LEFT JOIN mn USING (traj)"""
O["minimum_image_triclinic"] = W(POS, FRAMES, tri_min("traj, frame, atom_id", """SELECT a.traj, a.frame, a.atom_id,
  b.x-a.x AS x0, b.y-a.y AS y0, b.z-a.z AS z0, c.* EXCLUDE (traj, frame) FROM pos a
  JOIN pos b ON a.atom_id=b.atom_id AND b.frame=a.frame+1 JOIN cell c ON c.traj=a.traj AND c.frame=a.frame""")) + f"""
SELECT traj, frame, atom_id, {r('dx dy dz')} FROM mi"""
O["cell_volume"] = W(POS, FRAMES) + f"""
SELECT traj, frame, ROUND(v,6) AS volume, {r('ax bx "by" cx cy cz')},
  al=90 AND ga=90 AS orthorhombic FROM cell"""

# --- dynamics -------------------------------------------------------------------------------------

O["unwrap"] = W(POS, "s AS (SELECT atom_id, x-ux AS ox, y-uy AS oy, z-uz AS oz FROM pos WHERE frame=0)") + """
SELECT traj, frame, atom_id, ux+ox AS x, uy+oy AS y, uz+oz AS z FROM pos JOIN s USING (atom_id)"""

MASSES = "CASE site WHEN 'Li' THEN 6.94 WHEN 'N' THEN 14.007 WHEN 'O' THEN 15.999 WHEN 'S' THEN 32.06 ELSE 1.008 END::DOUBLE"
PARTS = f"""
parts AS MATERIALIZED (SELECT traj, frame, CASE site WHEN 'Li' THEN 'Li' WHEN 'H' THEN 'SOL' ELSE 'FSA' END AS label,
  MIN(atom_id) AS particle_id, SUM(m*ux)/SUM(m) AS x, SUM(m*uy)/SUM(m) AS y, SUM(m*uz)/SUM(m) AS z
  FROM (SELECT *, {MASSES} AS m FROM pos) GROUP BY traj, frame, 3, atom_id//5)"""
O["com"] = W(POS, PARTS) + f"SELECT traj, frame, particle_id, {r('x y z')} FROM parts WHERE label='FSA'"
O["drift_removed"] = W(POS, PARTS, f"""ctr AS (SELECT traj, frame, SUM(m*ux)/SUM(m) AS cx, SUM(m*uy)/SUM(m) AS cy,
  SUM(m*uz)/SUM(m) AS cz FROM (SELECT *, {MASSES} AS m FROM pos) GROUP BY traj, frame),
dr AS (SELECT c.traj, c.frame, c.cx-s.cx AS gx, c.cy-s.cy AS gy, c.cz-s.cz AS gz FROM ctr c JOIN ctr s ON s.traj=c.traj AND s.frame=0)""") + """
SELECT traj, frame, label, particle_id, ROUND(x-gx,6)+0.0::DOUBLE AS x, ROUND(y-gy,6)+0.0::DOUBLE AS y, ROUND(z-gz,6)+0.0::DOUBLE AS z
FROM parts JOIN dr USING (traj, frame)"""


def lagself(name: str, src: str, keys: str, sid: str, lag: int = 60) -> str:
    on = " AND ".join(f"a.{k}=b.{k}" for k in [*keys.split(), *sid.split()])
    return f"""{name} AS MATERIALIZED (SELECT {', '.join('a.' + k for k in keys.split())}, b.frame-a.frame AS lag,
  SUM((b.x-a.x)**2+(b.y-a.y)**2+(b.z-a.z)**2) AS total, COUNT(*) AS n FROM {src} a JOIN {src} b ON {on}
  AND b.frame>=a.frame AND b.frame<=a.frame+{lag} GROUP BY ALL)"""


O["msd_lag_join"] = W(POS, lagself("l", "walk", "traj", "atom_id")) + "SELECT traj, lag, ROUND(total/n,6) AS msd, n FROM l"
MSD = W(POS, PARTS, lagself("l", "parts", "traj label", "particle_id"),
        "m AS (SELECT traj, label, lag, lag*0.2::DOUBLE AS time, CASE WHEN lag=0 THEN 0.0::DOUBLE ELSE total/n END AS msd, n FROM l)")
O["msd_species"] = MSD + """SELECT traj, label, lag, ROUND(time,5) AS time, ROUND(msd,5) AS msd, n,
  CASE WHEN time>0 THEN ROUND(msd/(6*time),5) END AS D_A2_per_ns,
  CASE WHEN time>0 THEN ROUND(msd/(6*time)*1e-7/1e-5,5) END AS D_1e5_cm2_per_s FROM m"""


def curves(src: str = "parts", keys: str = "traj", lag: int = 60) -> str:
    """self, collective, cross and total curves of Li (+1) and FSA (-1)."""
    ks = keys.split()
    k = ", ".join(ks)
    using = ", ".join(ks)
    ak = ", ".join("a." + x for x in ks)
    on = " AND ".join(f"a.{x}=b.{x}" for x in ks)
    return f"""
ions AS (SELECT * FROM {src} WHERE label IN ('Li','FSA')),
{lagself('ls', 'ions', keys + ' label', 'particle_id', lag)},
cv AS MATERIALIZED (SELECT {k}, label, frame, SUM(x) AS x, SUM(y) AS y, SUM(z) AS z FROM ions GROUP BY ALL),
{lagself('lc', 'cv', keys + ' label', '', lag)},
q AS (SELECT {k}, frame, SUM(CASE label WHEN 'Li' THEN x ELSE -x END) AS x, SUM(CASE label WHEN 'Li' THEN y ELSE -y END) AS y,
  SUM(CASE label WHEN 'Li' THEN z ELSE -z END) AS z FROM cv GROUP BY ALL),
{lagself('lt', 'q', keys, '', lag)},
w2 AS (SELECT {ak}, a.frame, a.x AS px, a.y AS py, a.z AS pz, b.x AS mx, b.y AS my, b.z AS mz FROM cv a JOIN cv b ON {on}
  AND a.frame=b.frame WHERE a.label='Li' AND b.label='FSA'),
lx AS (SELECT {ak}, b.frame-a.frame AS lag, SUM((b.px-a.px)*(b.mx-a.mx)+(b.py-a.py)*(b.my-a.my)+(b.pz-a.pz)*(b.mz-a.mz)) AS total,
  COUNT(*) AS n FROM w2 a JOIN w2 b ON {on} AND b.frame>=a.frame AND b.frame<=a.frame+{lag} GROUP BY ALL),
sc AS (SELECT {k}, label, lag, s.total/c.n AS sv, c.total/c.n AS cv, s.total/s.n AS tr FROM ls s JOIN lc c USING ({using}, label, lag)),
cur AS MATERIALIZED (
  SELECT {k}, 'self:'||label AS term, 'self' AS kind, CASE label WHEN 'Li' THEN 1.0 ELSE -1.0 END::DOUBLE AS za,
    CASE label WHEN 'Li' THEN 1.0 ELSE -1.0 END::DOUBLE AS zb, 1.0::DOUBLE AS mult, lag, sv AS value, tr FROM sc
  UNION ALL SELECT {k}, 'distinct:'||label||'-'||label, 'same distinct', CASE label WHEN 'Li' THEN 1 ELSE -1 END,
    CASE label WHEN 'Li' THEN 1 ELSE -1 END, 1, lag, cv-sv, NULL FROM sc
  UNION ALL SELECT {k}, 'distinct:Li-FSA', 'cross distinct', 1, -1, 2, lag, total/n, NULL FROM lx
  UNION ALL SELECT {k}, 'total:charge', 'total', 1, 1, 1, lag, total/n, NULL FROM lt),
curves AS (SELECT * REPLACE (CASE WHEN lag=0 THEN 0 ELSE value END AS value), lag*0.2::DOUBLE AS time FROM cur)"""


SYSTEM = """sys AS (SELECT traj, AVG(20.0::DOUBLE*20*(20.0::DOUBLE+0.05::DOUBLE*(frame%7))) AS volume_A3,
  300.0::DOUBLE+30*CAST(SUBSTR(traj,4) AS INT) AS temperature_K FROM (SELECT DISTINCT traj, frame FROM pos) GROUP BY traj)"""
O["mean_volume"] = W(POS, SYSTEM) + "SELECT traj, ROUND(volume_A3,5) AS volume_A3, temperature_K FROM sys"
ONS = W(POS, PARTS, curves(), SYSTEM)
O["msd_collective"] = ONS + "SELECT traj, 'coll:'||label AS term, lag, ROUND(total/n,3) AS value FROM lc"
O["cross_displacement"] = ONS + "SELECT traj, 'cross:Li-FSA' AS term, lag, ROUND(total/n,3)+0.0::DOUBLE AS value FROM lx"
O["onsager_terms"] = ONS + """SELECT traj, term, kind, za, zb, mult, lag, ROUND(time,3) AS time, ROUND(value,3)+0.0::DOUBLE AS value FROM curves"""
SIG = "((1.602176634e-19::DOUBLE*1.602176634e-19::DOUBLE)*za*zb*({0}*1e-11::DOUBLE)/(6*(volume_A3*1e-30::DOUBLE)*1.380649e-23::DOUBLE*temperature_K))"
SIGMA = f""", sg AS (SELECT traj, term, kind, za, zb, mult, regr_slope(value,time) FILTER (time>=1.0 AND time<=8.0) AS s,
  regr_r2(value,time) FILTER (time>=1.0 AND time<=8.0) AS r2 FROM curves GROUP BY ALL),
sg2 AS (SELECT *, {SIG.format('s')} AS pair FROM sg JOIN sys USING (traj))"""
O["onsager_sigma"] = ONS + SIGMA + """
SELECT traj, term, kind, za, zb, mult, 1.0::DOUBLE AS fit_start_ns, 8.0::DOUBLE AS fit_end_ns, ROUND(s,5) AS slope_A2_per_ns, ROUND(r2,5) AS fit_R2,
  ROUND(pair,5)+0.0::DOUBLE AS sigma_pair_S_per_m, ROUND(pair*mult,5)+0.0::DOUBLE AS sigma_contribution_S_per_m, ROUND(pair*mult*10,5)+0.0::DOUBLE AS sigma_contribution_mS_per_cm FROM sg2"""
O["onsager_check"] = ONS + SIGMA + """
SELECT traj, ROUND(SUM(pair*mult*10) FILTER (term='total:charge'),4) AS sigma_decomposed_mS_cm,
  ROUND(SUM(pair*mult*10) FILTER (term='total:charge'),4) AS sigma_direct_total_mS_cm FROM sg2 GROUP BY traj"""


def expanding(src: str, keys: str, value: str = "value", start: float = 1.0) -> str:
    return f"""(CASE WHEN time>={start} AND COUNT(CASE WHEN time>={start} THEN {value} END) OVER w>=8 THEN
  regr_slope(CASE WHEN time>={start} THEN {value} END, CASE WHEN time>={start} THEN time END) OVER w END)"""


O["running_sigma"] = ONS + f""", e AS (SELECT *, {expanding('curves', '')} AS s FROM curves JOIN sys USING (traj)
  WINDOW w AS (PARTITION BY traj, term ORDER BY time ROWS UNBOUNDED PRECEDING))
SELECT traj, term, lag, ROUND(time,4) AS time, ROUND({SIG.format('s')}*mult*10,4)+0.0::DOUBLE AS sigma_mS_cm FROM e"""

FITD = """, wd AS (SELECT traj, label, FLOOR(0.2::DOUBLE*COUNT(*))*(MAX(time)/GREATEST(MAX(lag),1)) AS lo,
  FLOOR(0.8::DOUBLE*COUNT(*))*(MAX(time)/GREATEST(MAX(lag),1)) AS hi FROM m GROUP BY ALL),
fd AS (SELECT traj, label, lo, hi, regr_slope(msd,time) AS s, regr_intercept(msd,time) AS ic, regr_r2(msd,time) AS r2,
  regr_slope(LOG10(msd),LOG10(time)) AS al FROM m JOIN wd USING (traj, label)
  WHERE time>0 AND time>=lo-1e-9 AND time<=hi+1e-9 GROUP BY ALL)"""
O["diffusion_fit"] = MSD + FITD + """SELECT traj, label, ROUND(lo,5) AS fit_start_ns, ROUND(hi,5) AS fit_end_ns, ROUND(s,5) AS slope_A2_per_ns,
  ROUND(ic,5) AS intercept_A2, ROUND(s/6,5) AS D_A2_per_ns, ROUND(s/6,5) AS D_m2_per_s, ROUND(s/6,5) AS D_cm2_per_s,
  ROUND(s/6*1e-7/1e-5,5) AS D_1e5_cm2_per_s, ROUND(al,5) AS loglog_alpha, ROUND(r2,5) AS r2 FROM fd"""
NE = FITD + f""", {SYSTEM}, np AS (SELECT traj, label, COUNT(*) AS n_particles FROM parts WHERE frame=0 GROUP BY ALL),
ne AS (SELECT *, CASE label WHEN 'SOL' THEN 0 ELSE 1 END AS z2, n_particles/(volume_A3*1e-30::DOUBLE) AS nd, s/6*1e-11::DOUBLE AS d FROM fd
  JOIN np USING (traj, label) JOIN sys USING (traj)),
ne2 AS (SELECT *, nd*z2*(1.602176634e-19::DOUBLE*1.602176634e-19::DOUBLE)*d/(1.380649e-23::DOUBLE*temperature_K) AS sig FROM ne)"""
O["ne_conductivity"] = MSD + NE + """SELECT traj, label, n_particles, ROUND(nd*1e-24,5) AS number_density_m3,
  ROUND(nd/(6.02214076e23*1000),5) AS concentration_mol_L, ROUND(sig,5) AS sigma_NE_S_m, ROUND(sig*10,5) AS sigma_NE_mS_cm FROM ne2"""
O["system_sigma"] = MSD + NE + """SELECT traj, ROUND(SUM(sig),5) AS sigma_total_NE_S_m, ROUND(SUM(sig)*10,5) AS sigma_total_NE_mS_cm,
  STRING_AGG(label,'+' ORDER BY label) AS species_included FROM ne2 GROUP BY traj"""
O["diffusion_vs_temperature"] = MSD + NE + """SELECT traj, label, temperature_K, ROUND(1000/temperature_K,5) AS inv_T,
  ROUND(LOG10(s/6*1e-7),5) AS log10_D, ROUND(sig*10,5) AS sigma_NE_mS_cm FROM ne2"""
O["arrhenius"] = ONS + SIGMA + """, sgt AS (SELECT traj, temperature_K AS t, SUM(pair*mult*10) AS sg FROM sg2 WHERE kind='self' GROUP BY ALL),
f AS (SELECT COUNT(*) AS n, regr_slope(LOG10(sg*t),1000/t) AS s, regr_intercept(LOG10(sg*t),1000/t) AS i FROM sgt WHERE sg>0)
SELECT n, ROUND(s,5) AS slope, ROUND(i,5) AS intercept, ROUND(-1000*LN(10.0)*8.617333262145e-5*s,5) AS Ea_eV FROM f"""

REF = """
sol AS (SELECT traj, frame, AVG(x) AS sx, AVG(y) AS sy, AVG(z) AS sz FROM parts WHERE label='SOL' GROUP BY ALL),
fref AS MATERIALIZED (SELECT *, 'barycentric' AS ref FROM parts WHERE label<>'SOL' UNION ALL
  SELECT traj, frame, label, particle_id, x-sx, y-sy, z-sz, 'solvent_fixed' FROM parts JOIN sol USING (traj, frame) WHERE label<>'SOL')"""


def five(keys: str) -> str:
    return f""", pc AS (SELECT {keys}, CASE label WHEN 'Li' THEN 'Dplus' ELSE 'Dminus' END AS name, lag, total, n FROM ls
  UNION ALL SELECT {keys}, CASE label WHEN 'Li' THEN 'Lpp' ELSE 'Lmm' END, lag, total, n FROM lc
  UNION ALL SELECT {keys}, 'Lpm', lag, total, n FROM lx),
pcv AS (SELECT {keys}, name, lag, lag*0.2::DOUBLE AS time, CASE WHEN lag=0 THEN 0 ELSE total/n END AS value FROM pc)"""


TN = """Dplus/NULLIF(Dplus+Dminus,0) AS PFG_t_app, (Lpp-Lpm)/NULLIF(Lpp+Lmm-2*Lpm,0) AS eNMR_t0,
  (Lpp-Lpm*Lpm/NULLIF(Lmm,0))/NULLIF(Lpp+Lmm-2*Lpm,0) AS Bruce_Vincent_tss, Lpp+Lmm-2*Lpm AS sigma_reduced"""
PIV = ", ".join(f"MAX(CASE WHEN name='{n}' THEN s END) AS {n}" for n in ("Dplus", "Dminus", "Lpp", "Lmm", "Lpm"))
O["transference_running"] = W(POS, PARTS, REF, curves("fref", "traj ref")) + five("traj, ref") + f"""
, e AS (SELECT traj, ref, name, lag, {expanding('pcv', '')} AS s FROM pcv
  WINDOW w AS (PARTITION BY traj, ref, name ORDER BY time ROWS UNBOUNDED PRECEDING)),
p5 AS (SELECT traj, ref, lag, {PIV} FROM e GROUP BY ALL), tn AS (SELECT *, {TN} FROM p5)
SELECT traj, ref, lag, {r('Dplus PFG_t_app eNMR_t0 Bruce_Vincent_tss sigma_reduced', 4)} FROM tn"""


def blocks(src: str, name: str = "blk", keep: int = 4) -> str:
    return f"""{name} AS MATERIALIZED (SELECT s.* REPLACE (frame%len AS frame), CAST(frame//len AS INT) AS block FROM {src} s
  JOIN (SELECT traj, (MAX(frame)+1)//4 AS len FROM {src} GROUP BY traj) USING (traj) WHERE len>={keep} AND frame//len<4)"""


BLK = W(POS, PARTS, REF, blocks("fref", keep=10), curves("blk", "traj ref block")) + five("traj, ref, block") + f"""
, e AS (SELECT traj, ref, block, name, CASE WHEN COUNT(*)>=3 THEN regr_slope(value,time) END AS s FROM pcv WHERE time>=0.4 AND time<=3.0 GROUP BY ALL),
p5 AS (SELECT traj, ref, block, {PIV} FROM e GROUP BY ALL), tn AS (SELECT *, {TN} FROM p5)"""
O["transference_blocks"] = BLK + f"""
SELECT traj, ref, block, {r('Dplus Dminus Lpp Lmm Lpm PFG_t_app eNMR_t0 Bruce_Vincent_tss sigma_reduced', 4)} FROM tn"""
O["transference_block_error"] = BLK + " UNION ALL ".join(f"""
SELECT traj, ref, '{c}' AS quantity, '{m}' AS mode, ROUND(AVG({c}),4) AS mean, ROUND(STDDEV_SAMP({c})*{s},4) AS err FROM tn GROUP BY traj, ref"""
    for c, m, s in (("Dplus", "sem", "0.5"), ("Dminus", "sd", "1"), ("Lpp", "ci95", "1.96/2")))
O["block_estimate_stats"] = BLK + " UNION ALL ".join(f"""
SELECT '{c}' AS quantity, COUNT({c}) AS n, ROUND(AVG({c}),4) AS mean, ROUND(STDDEV_SAMP({c}),4) AS sd,
  ROUND(STDDEV_SAMP({c})/SQRT(COUNT({c})),4) AS sem, ROUND(1.96*STDDEV_SAMP({c})/SQRT(COUNT({c})),4) AS ci95
FROM tn WHERE ref='solvent_fixed'""" for c in ("PFG_t_app", "Dplus", "Dminus"))
BM = W(POS, PARTS, blocks("parts"), curves("blk", "traj block", 15)) + """
, sh AS (SELECT traj, block, term, lag, time, CASE WHEN kind='self' THEN CASE WHEN lag=0 THEN 0 ELSE tr END ELSE mult*za*zb*value END AS v FROM curves),
bm AS (SELECT traj, term, lag, time, AVG(v) AS mean, STDDEV_SAMP(v)/2 AS err FROM sh GROUP BY ALL)"""
O["block_msd"] = BM + f"SELECT traj, term, lag, {r('time mean err', 3)} FROM bm"
O["axis_range"] = BM + """, ex AS (SELECT term, MIN(mean-err) AS lo, MAX(mean+err) AS hi FROM bm GROUP BY term)
SELECT term, ROUND(lo-(hi-lo)*0.05,3)+0.0::DOUBLE AS lo, ROUND(hi+(hi-lo)*0.05,3)+0.0::DOUBLE AS hi FROM ex"""


def solvent(src: str, keys: str, lag: int = 60) -> str:
    k = ", ".join(keys.split())
    return f"""so AS (SELECT * FROM {src} WHERE label='SOL'),
{lagself('ls', 'so', keys, 'particle_id', lag)}, mc AS (SELECT {k}, frame, AVG(x) AS x, AVG(y) AS y, AVG(z) AS z FROM so GROUP BY ALL),
{lagself('lc', 'mc', keys, '', lag)},
sv AS (SELECT {k}, lag, lag*0.2::DOUBLE AS time, s.n//c.n AS n_solvent, CASE WHEN lag=0 THEN 0 ELSE s.total/s.n END AS self_msd,
  CASE WHEN lag=0 THEN 0 ELSE c.total/c.n END AS com_msd FROM ls s JOIN lc c USING ({k}, lag)),
sv2 AS (SELECT *, n_solvent*com_msd AS n_com_msd, CASE WHEN self_msd>0 THEN n_solvent*com_msd/self_msd END AS ratio FROM sv)"""


SOLV = W(POS, PARTS, solvent("parts", "traj"))
O["solvent_diagnostics"] = SOLV + f"SELECT traj, lag, {r('time', 5)}, n_solvent, {r('self_msd com_msd n_com_msd ratio', 5)} FROM sv2"
O["solvent_diffusion"] = SOLV + " UNION ALL ".join(f"""
SELECT traj, '{q}' AS quantity, n_solvent, ROUND(regr_slope({c},time),5) AS slope_A2_per_ns, ROUND(regr_slope({c},time)/6,5) AS D_cm2_per_s,
  ROUND(regr_r2({c},time),5) AS fit_R2 FROM sv2 WHERE time>=1.0 AND time<=8.0 GROUP BY traj, n_solvent"""
    for q, c in (("self", "self_msd"), ("mean_com", "com_msd"), ("n_times_mean_com", "n_com_msd")))
O["solvent_running"] = SOLV + f"""SELECT traj, lag, ROUND(time,5) AS time, ROUND({expanding('', '', 'self_msd')}/6,5) AS D_self_cm2_per_s,
  ROUND({expanding('', '', 'n_com_msd')}/6,5) AS D_n_com_cm2_per_s FROM sv2 WINDOW w AS (PARTITION BY traj ORDER BY time ROWS UNBOUNDED PRECEDING)"""
O["solvent_blocks"] = W(POS, PARTS, blocks("parts"), solvent("blk", "traj block", 15)) + """
SELECT traj, lag, ROUND(AVG(self_msd),4) AS self_mean, ROUND(STDDEV_SAMP(self_msd)/2,4) AS self_err, ROUND(AVG(com_msd),4) AS com_mean,
  ROUND(STDDEV_SAMP(com_msd)/2,4) AS com_err FROM sv2 GROUP BY traj, lag"""

# --- contacts ---------------------------------------------------------------------------------------


def hysteresis(cand: str, tag: str = "") -> str:
    """Active frames by a frame-by-frame state machine (recursive), not by runs of frames."""
    return f"""
c{tag} AS MATERIALIZED (SELECT traj, frame, i, mol_id, r2 FROM {cand} WHERE r2<=64),
act{tag} AS (SELECT traj, frame, i, mol_id FROM c{tag} WHERE r2<=36 UNION
  SELECT n.traj, n.frame, n.i, n.mol_id FROM act{tag} a JOIN c{tag} n ON n.traj=a.traj AND n.i=a.i AND n.mol_id=a.mol_id AND n.frame=a.frame+1)"""


LEN = "len AS (SELECT traj, MAX(frame)+1 AS nf FROM pos GROUP BY traj)"
EV = """
ev AS MATERIALIZED (SELECT e.*, nf, e.s=0 AS lc, e.e=nf-1 AS rc FROM (SELECT traj, i, mol_id, MIN(frame) AS s, MAX(frame) AS e, COUNT(*) AS n FROM
  (SELECT *, frame-ROW_NUMBER() OVER (PARTITION BY traj, i, mol_id ORDER BY frame) AS g FROM act) GROUP BY traj, i, mol_id, g) e JOIN len USING (traj))"""
CON = W(POS, pairs("p", "('Li')", "('N','O','S')"), MOLP, hysteresis("cand"), LEN, EV.replace("ev AS", "evt AS", 1))
O["contact_events"] = CON + """SELECT traj, i, mol_id, s AS start_frame, e AS end_frame, n AS n_observed_frames, ROUND(n*0.2::DOUBLE,6) AS duration_grid_ns,
  ROUND((n-1)*0.2::DOUBLE,6) AS duration_lower_bound_ns, CASE WHEN NOT lc AND NOT rc THEN ROUND((n+1)*0.2::DOUBLE,6) END AS duration_upper_bound_ns,
  lc AS left_censored, rc AS right_censored FROM evt"""
CAT = "cat AS (SELECT traj, frame, atom_id AS i FROM pos WHERE site='Li')"
O["coordination_states"] = W(POS, pairs("p", "('Li')", "('N','O','S')"), MOLP, hysteresis("cand"), pairs("p2", "('Li')", "('H')"),
    "cand2 AS (SELECT traj, frame, i, j AS mol_id, r2 FROM p2)", hysteresis("cand2", "2"), CAT) + """
, k AS (SELECT traj, frame, i, (SELECT COUNT(*) FROM act a WHERE a.frame=c.frame AND a.i=c.i) AS n_anion,
  (SELECT COUNT(*) FROM act2 a WHERE a.frame=c.frame AND a.i=c.i) AS n_solvent FROM cat c),
s AS (SELECT traj, n_anion, n_solvent, COUNT(*) AS count FROM k GROUP BY ALL)
SELECT traj, n_anion, n_solvent, count, ROUND(count/SUM(count) OVER (PARTITION BY traj),6) AS probability FROM s"""
O["residence_summary"] = CON + """, occ AS (SELECT traj, COUNT(*) AS occupied FROM act GROUP BY traj),
nk AS (SELECT traj, COUNT(DISTINCT atom_id) FILTER (site='Li') AS nc, COUNT(DISTINCT atom_id//5) FILTER (site IN ('N','O','S')) AS nm FROM pos GROUP BY traj),
sm AS (SELECT traj, COUNT(*) AS ne, COUNT(*) FILTER (NOT lc AND NOT rc) AS ncomp, COUNT(*) FILTER (lc) AS nl, COUNT(*) FILTER (rc) AS nr,
  MEDIAN(n*0.2::DOUBLE) FILTER (NOT lc AND NOT rc) AS med, AVG(n*0.2::DOUBLE) FILTER (NOT lc AND NOT rc) AS av FROM evt GROUP BY traj)
SELECT traj, nf AS n_frames, nc AS n_cations, nm AS n_molecules, ne AS n_events, ncomp AS n_complete_events, nl AS n_left_censored, nr AS n_right_censored,
  ROUND(med,6) AS median_complete_duration_grid_ns, ROUND(av,6) AS mean_complete_duration_grid_ns, occupied AS occupied_pair_frames,
  ROUND(occupied/(nf*nc),6) AS mean_coordination, ROUND(occupied/(nf*nc*nm),6) AS contact_occupancy_fraction, ne AS formed_transitions,
  ne-nr AS broken_transitions FROM len JOIN nk USING (traj) JOIN sm USING (traj) JOIN occ USING (traj)"""
LAGS = ", lg AS (SELECT traj, nf, l AS lag FROM len, RANGE(1000) t(l) WHERE l<=GREATEST(1,(nf-1)//2))"
CONT = LAGS + """, ct AS (SELECT lg.traj, lg.lag, SUM(GREATEST(n-lag,0))/SUM(n) AS survival FROM lg JOIN evt USING (traj) GROUP BY ALL)"""
O["survival_continuous"] = CON + CONT + "SELECT traj, lag, ROUND(survival,6) AS survival FROM ct"
INTER = """, num AS (SELECT a.traj, b.frame-a.frame AS lag, COUNT(*) AS c FROM act a JOIN act b ON a.traj=b.traj AND a.i=b.i AND a.mol_id=b.mol_id
  AND b.frame>=a.frame GROUP BY ALL), tot AS (SELECT traj, COUNT(*) AS t FROM act GROUP BY traj),
it AS (SELECT lg.traj, lg.lag, COALESCE(c,0)*nf/((nf-lg.lag)*t) AS survival FROM lg JOIN tot USING (traj) LEFT JOIN num USING (traj, lag))"""
O["survival_intermittent"] = CON + LAGS + INTER + "SELECT traj, lag, ROUND(survival,6) AS survival FROM it"


def kww(curves: str, last: str = "SELECT * FROM kf") -> str:
    """Least squares over the shrinking grid, round by round, over curves (traj, curve, x, y, free)."""
    out = f""", cv AS MATERIALIZED ({curves}),
tl AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY traj, curve ORDER BY x DESC) AS back, COUNT(*) OVER (PARTITION BY traj, curve) AS m FROM cv),
sp AS MATERIALIZED (SELECT traj, curve, free, COUNT(*) AS n, MAX(x) AS fe, AVG(y) AS mean, MIN(CASE WHEN x>0 THEN x END) AS step,
  MEDIAN(CASE WHEN back<=GREATEST(3, CEIL(m*0.1)) THEN y END) AS level FROM tl GROUP BY ALL),
r0 AS (SELECT traj, curve, free, LN(GREATEST(step*0.05, 1e-12)) AS lo0, LN(GREATEST(100*fe, step)) AS hi0, LN(GREATEST(step*0.05, 1e-12)) AS lo,
  LN(GREATEST(100*fe, step)) AS hi, 0.1::DOUBLE AS bl, 2.0::DOUBLE AS bh FROM sp)"""
    for k in range(5):
        out += f""",
g{k} AS (SELECT traj, curve, free, lo0, hi0, lo, hi, bl, bh, idx, EXP(lo+(hi-lo)*(idx//79)/80) AS tau, bl+(bh-bl)*(idx%79)/78 AS beta FROM r{k}, RANGE(6399) t(idx)),
e{k} AS (SELECT g.*, y, EXP(-LEAST(POW(x/tau, beta), 700)) AS e FROM g{k} g JOIN cv USING (traj, curve)),
s{k} AS (SELECT traj, curve, free, lo0, hi0, lo, hi, bl, bh, idx, tau, beta, SUM((1-e)*(1-e)) AS uu, SUM((1-e)*(y-e)) AS uv, SUM((y-e)*(y-e)) AS vv FROM e{k} GROUP BY ALL),
p{k} AS (SELECT *, CASE WHEN free THEN GREATEST(0, LEAST(0.999, COALESCE(uv/NULLIF(uu,0), 0))) ELSE 0 END AS p FROM s{k}),
b{k} AS MATERIALIZED (SELECT * FROM p{k} QUALIFY ROW_NUMBER() OVER (PARTITION BY traj, curve ORDER BY vv-2*p*uv+p*p*uu, idx)=1),
r{k + 1} AS (SELECT traj, curve, free, lo0, hi0, GREATEST(lo0, LN(tau)-3*(hi-lo)/80) AS lo, LEAST(hi0, LN(tau)+3*(hi-lo)/80) AS hi,
  GREATEST(0.1, beta-3*(bh-bl)/78) AS bl, LEAST(2, beta+3*(bh-bl)/78) AS bh FROM b{k})"""
    return out + """,
er AS (SELECT traj, curve, SUM((y-(p+(1-p)*EXP(-LEAST(POW(x/tau, beta), 700))))**2) AS sse, SUM((y-mean)**2) AS total FROM cv JOIN b4 USING (traj, curve) JOIN sp USING (traj, curve) GROUP BY ALL),
ft AS (SELECT b4.traj, b4.curve, fe, tau, beta, p, 1-sse/total AS r2, EXP(-LEAST(POW(fe/tau, beta), 700)) AS rest,
  CASE WHEN 1-sse/total<0.9 THEN CASE WHEN b4.free THEN GREATEST(0, LEAST(0.95, level)) ELSE 0 END ELSE p END AS q FROM b4 JOIN er USING (traj, curve) JOIN sp USING (traj, curve)),
un AS (SELECT traj, curve, x, LEAST(1, GREATEST(0, (y-q)/(1-q))) AS y FROM cv JOIN ft USING (traj, curve)),
lg2 AS (SELECT *, LAG(x) OVER w AS px, LAG(y) OVER w AS py FROM un WINDOW w AS (PARTITION BY traj, curve ORDER BY x)),
ob AS (SELECT traj, curve, SUM((x-px)*(y+py)/2) AS area,
  ARG_MIN(CASE WHEN px IS NULL OR y=py THEN x ELSE px+(0.5-py)/(y-py)*(x-px) END, x) FILTER (WHERE y<=0.5) AS half,
  ARG_MIN(CASE WHEN px IS NULL OR y=py THEN x ELSE px+(EXP(-1)-py)/(y-py)*(x-px) END, x) FILTER (WHERE y<=EXP(-1)) AS efold, ARG_MIN(y, x) AS y0 FROM lg2 GROUP BY ALL),
kf AS (SELECT traj, curve, CASE WHEN r2<0.9 THEN 'fit_poor_r_squared' WHEN rest<=0.05 THEN 'relaxed_within_fit_window' ELSE 'lower_bound_window_limited' END AS fit_status,
  ROUND(fe,4) AS fit_end, ROUND(tau,4) AS tau, ROUND(beta,4) AS beta, ROUND(p,4) AS plateau, ROUND(rest,4) AS remaining, ROUND(r2,4) AS r_squared,
  ROUND(q,4) AS integral_plateau, ROUND(area,4) AS restricted_integral, CASE WHEN y0>=0.5 THEN ROUND(half,4) END AS t_half_observed,
  CASE WHEN y0>=EXP(-1) THEN ROUND(efold,4) END AS t_1e_observed, ROUND(tau*GAMMA(1+1/beta),4) AS tau_mean FROM ft JOIN ob USING (traj, curve))
""" + last


O["kww_fit"] = CON + CONT + INTER + kww("""SELECT traj, 'continuous' AS curve, lag*0.2::DOUBLE AS x, LEAST(1.05::DOUBLE, GREATEST(0, survival)) AS y, false AS free FROM ct
  UNION ALL SELECT traj, 'intermittent', lag*0.2::DOUBLE, LEAST(1.05::DOUBLE, GREATEST(0, survival)), true FROM it""")
KM = LAGS + """, rk AS (SELECT lg.traj, lag, COUNT(*) FILTER (n>=lag) AS risk, COUNT(*) FILTER (n=lag AND NOT rc) AS d FROM lg JOIN evt USING (traj)
  WHERE NOT lc GROUP BY lg.traj, lag),
km AS (SELECT traj, lag, PRODUCT(CASE WHEN lag>0 AND risk>0 THEN 1-d/risk ELSE 1 END) OVER (PARTITION BY traj ORDER BY lag) AS survival FROM rk)"""
O["survival_km"] = CON + KM + "SELECT traj, lag, ROUND(survival,6) AS survival FROM km"


def trapz(src: str) -> str:
    return f"""SELECT traj, SUM(a) AS integral, COUNT(*) AS n FROM (SELECT traj,
  (lag*0.2::DOUBLE-LAG(lag*0.2::DOUBLE) OVER w)*(survival+LAG(survival) OVER w)*0.5 AS a FROM {src} WINDOW w AS (PARTITION BY traj ORDER BY lag)) GROUP BY traj"""


def cross(level: str, name: str) -> str:
    return f"""{name} AS (SELECT traj, CASE WHEN y0>={level} THEN t END AS t FROM (SELECT traj, MIN_BY(survival, lag) AS y0,
  MIN_BY(CASE WHEN pl IS NULL OR survival=ps THEN lag*0.2::DOUBLE ELSE pl+({level}-ps)/(survival-ps)*(lag*0.2::DOUBLE-pl) END, lag) FILTER (survival<={level}) AS t
  FROM (SELECT *, LAG(survival) OVER w AS ps, LAG(lag*0.2::DOUBLE) OVER w AS pl FROM km WINDOW w AS (PARTITION BY traj ORDER BY lag)) GROUP BY traj))"""


O["km_rmst"] = CON + KM + f""", rm AS ({trapz('km')}), {cross('0.5::DOUBLE', 'md')}, {cross('EXP(-1.0::DOUBLE)', 'te')},
en AS (SELECT traj, MAX_BY(survival, lag) AS s FROM km GROUP BY traj)
SELECT traj, ROUND(s,6) AS survival_at_end, ROUND(integral,6) AS rmst, ROUND(md.t,6) AS t_median, ROUND(te.t,6) AS t_1e,
  CASE WHEN s<=0.05 THEN 'relaxed_within_window' ELSE 'lower_bound_window_limited' END AS status
FROM en JOIN rm USING (traj) JOIN md USING (traj) JOIN te USING (traj)"""
# Contacts whose radii come from each trajectory's own smoothed g(r).
AUTO = W(POS, EVEN.replace("25", "200"), pairs("near", "('Li')", "('N','O','S')"), TRAJS, grid(60), """
hist AS (SELECT traj, LEAST(CAST(FLOOR(SQRT(r2)/0.1::DOUBLE) AS INT), 59) AS bin, COUNT(*) AS c FROM near SEMI JOIN ev200 USING (traj, frame) WHERE r2<=36 GROUP BY ALL),
norms AS (SELECT traj, SUM(n1*n2/8000.0::DOUBLE) AS pf, SUM(n1) AS tn1 FROM (SELECT traj, frame, COUNT(*) FILTER (site='Li') AS n1,
  COUNT(*) FILTER (site IN ('N','O','S')) AS n2 FROM pos SEMI JOIN ev200 USING (traj, frame) GROUP BY traj, frame) GROUP BY traj),
g AS (SELECT traj, bin, (bin+0.5::DOUBLE)*0.1::DOUBLE AS r, COALESCE(c,0)/(pf*4.0::DOUBLE/3.0*pi()*(((bin+1)*0.1::DOUBLE)**3-(bin*0.1::DOUBLE)**3)) AS g
  FROM grid JOIN norms USING (traj) LEFT JOIN hist USING (traj, bin)),
taps AS (SELECT o, EXP(-0.5*(o/3.0)**2)/SUM(EXP(-0.5*(o/3.0)**2)) OVER () AS w FROM RANGE(-12,13) t(o)),
sm AS (SELECT a.traj, a.bin, a.r, SUM(w*b.g) AS v FROM g a, taps JOIN g b ON b.bin=GREATEST(0, LEAST(59, a.bin+o)) AND b.traj=a.traj GROUP BY ALL),
n AS (SELECT traj, bin, r, v, LAG(v) OVER w AS l, LEAD(v) OVER w AS u FROM sm WINDOW w AS (PARTITION BY traj ORDER BY bin)),
pk AS (SELECT traj, r, v, MAX(v) OVER (PARTITION BY traj) AS top FROM n WHERE v>l AND v>u AND r>=1.2),
first_pk AS (SELECT traj, MIN(r) AS rp FROM pk WHERE v>=0.1*top GROUP BY traj),
cut AS MATERIALIZED (SELECT n.traj, MIN(n.r) AS r_on FROM n JOIN first_pk f USING (traj) WHERE v<l AND v<u AND n.r-rp>=0.2-1e-9 GROUP BY n.traj),
cand AS (SELECT traj, frame, i, (j//5)*5+1 AS mol_id, MIN(r2) AS r2 FROM near WHERE r2<=42.25 GROUP BY ALL),
c AS MATERIALIZED (SELECT cand.*, r_on FROM cand JOIN cut USING (traj) WHERE r2<=(r_on+0.5)*(r_on+0.5)),
act AS (SELECT traj, frame, i, mol_id FROM c WHERE r2<=r_on*r_on UNION
  SELECT n.traj, n.frame, n.i, n.mol_id FROM act a JOIN c n ON n.traj=a.traj AND n.i=a.i AND n.mol_id=a.mol_id AND n.frame=a.frame+1)""",
    LEN, EV.replace("ev AS", "evt AS", 1))
O["flow_residence_auto"] = AUTO + CONT + INTER + KM[len(LAGS):] + f""", rm AS ({trapz('km')}), {cross('0.5::DOUBLE', 'md')}, {cross('EXP(-1.0::DOUBLE)', 'te')},
en AS (SELECT traj, MAX_BY(survival, lag) AS s FROM km GROUP BY traj)""" + kww("""SELECT traj, 'continuous' AS curve, lag*0.2::DOUBLE AS x, LEAST(1.05::DOUBLE, GREATEST(0, survival)) AS y, false AS free FROM ct
  UNION ALL SELECT traj, 'intermittent', lag*0.2::DOUBLE, LEAST(1.05::DOUBLE, GREATEST(0, survival)), true FROM it""", """
SELECT * RENAME (curve AS correlation) FROM kf UNION ALL BY NAME SELECT traj, 'kaplan_meier' AS correlation, ROUND(s,4) AS remaining, ROUND(integral,4) AS restricted_integral,
  ROUND(md.t,4) AS t_half_observed, ROUND(te.t,4) AS t_1e_observed, CASE WHEN s<=0.05 THEN 'relaxed_within_window' ELSE 'lower_bound_window_limited' END AS fit_status
FROM en JOIN rm USING (traj) JOIN md USING (traj) JOIN te USING (traj)""")
O["correlation_integrals"] = CON + CONT + INTER + f"""
SELECT traj, 'continuous' AS curve, n, ROUND(integral,6) AS integral FROM ({trapz('ct')})
UNION ALL SELECT traj, 'intermittent', n, ROUND(integral,6) FROM ({trapz('it')})"""

# --- run logs ---------------------------------------------------------------------------------------

# Log times are 10, 20, ...: only the two multiples of 10 around a snapshot can be nearest.
NEAR = """cnd AS (SELECT s.series, s.run_index, s.o_orderkey, l.time_ps AS lt, l.potential_kcal_mol, l.kinetic_kcal_mol,
  ROW_NUMBER() OVER (PARTITION BY s.o_orderkey ORDER BY ABS(l.time_ps-s.time_ps), l.time_ps) AS rk
  FROM snaps s JOIN logs l ON l.series=s.series AND l.run_index=s.run_index AND l.time_ps IN (FLOOR(s.time_ps/10)*10, FLOOR(s.time_ps/10)*10+10)
  WHERE ABS(l.time_ps-s.time_ps)<=3.0),
mg AS MATERIALIZED (SELECT s.*, lt, potential_kcal_mol, kinetic_kcal_mol FROM snaps s LEFT JOIN (SELECT * FROM cnd WHERE rk=1) c
  USING (series, run_index, o_orderkey))"""
O["log_asof"] = W(RUNS, NEAR) + """SELECT series, run_index, o_orderkey, time_ps, lt AS time_ps_log, ROUND(a_A,4) AS a_A,
  ROUND(potential_kcal_mol,4) AS potential_kcal_mol, ROUND(kinetic_kcal_mol,4) AS kinetic_kcal_mol FROM mg"""
O["log_asof_left_log"] = W(RUNS, """bk AS (SELECT l.*, s.time_ps AS bt, s.o_orderkey AS bkey, s.a_A AS ba FROM
  (SELECT *, time_ps AS t FROM logs) l ASOF LEFT JOIN (SELECT *, time_ps + o_orderkey*1e-9 AS t, series AS s1, run_index AS r1 FROM snaps) s
  ON l.series=s.s1 AND l.run_index=s.r1 AND l.t+0.5>=s.t),
fw AS (SELECT l.*, s.time_ps AS ft, s.o_orderkey AS fkey, s.a_A AS fa FROM
  bk l ASOF LEFT JOIN (SELECT *, time_ps + o_orderkey*1e-9 AS t, series AS s1, run_index AS r1 FROM snaps) s
  ON l.series=s.s1 AND l.run_index=s.r1 AND l.time_ps+0.5<s.t),
pk AS (SELECT *, ft IS NULL OR (bt IS NOT NULL AND time_ps-bt<=ft-time_ps) AS b FROM fw)""") + """
SELECT series, run_index, time_ps, CASE WHEN b THEN bt ELSE ft END AS time_ps_snap, CASE WHEN b THEN bkey ELSE fkey END AS snap_key,
  ROUND(CASE WHEN b THEN ba ELSE fa END,4) AS a_A, ROUND(kinetic_kcal_mol,4) AS kinetic_kcal_mol FROM pk"""
O["merge_by_position"] = W(RUNS, """a AS (SELECT series, run_index, time_ps AS log_time, ROW_NUMBER() OVER (PARTITION BY series, run_index ORDER BY time_ps) AS n FROM logs),
b AS (SELECT series, run_index, o_orderkey, time_ps AS snap_time, ROW_NUMBER() OVER (PARTITION BY series, run_index ORDER BY time_ps, o_orderkey) AS n FROM snaps WHERE a_A IS NOT NULL)""") + """
SELECT series, run_index, log_time, o_orderkey, snap_time FROM a FULL JOIN b USING (series, run_index, n)"""
STEP = """ts AS (SELECT series, run_index, COALESCE(MEDIAN(d) FILTER (d>1e-12), 50) AS dt FROM (SELECT series, run_index,
  time_ps-LAG(time_ps) OVER (PARTITION BY series, run_index ORDER BY time_ps) AS d FROM (SELECT DISTINCT series, run_index, time_ps FROM snaps)) GROUP BY ALL)"""
O["time_step"] = W(RUNS, STEP) + "SELECT series, run_index, ROUND(dt,6) AS dt FROM ts"
STITCH = """sp AS (SELECT series, run_index, MIN(time_ps) AS lo, MAX(time_ps) AS hi FROM snaps GROUP BY ALL),
fold AS (SELECT series, run_index, 0.0::DOUBLE AS off, hi AS top FROM sp WHERE run_index=1 UNION ALL
  SELECT s.series, s.run_index, CASE WHEN lo<=top+1e-9 THEN top+dt-lo ELSE 0 END, hi+CASE WHEN lo<=top+1e-9 THEN top+dt-lo ELSE 0 END
  FROM fold f JOIN sp s ON s.series=f.series AND s.run_index=f.run_index+1 JOIN ts ON ts.series=s.series AND ts.run_index=s.run_index),
st AS MATERIALIZED (SELECT mg.* REPLACE (time_ps+off AS time_ps), time_ps AS time_ps_local, off FROM mg JOIN fold USING (series, run_index)),
dv AS MATERIALIZED (SELECT *, a_A*b_A*c_A*SQRT(GREATEST(1-3*COS(RADIANS(90.0::DOUBLE))**2+2*COS(RADIANS(90.0::DOUBLE))**3,0)) AS v FROM st),
dc AS MATERIALIZED (SELECT *, 4800.0::DOUBLE/(6.02214076e23*v*1e-24) AS de, 12.0::DOUBLE/(6.02214076e23*v*1e-27) AS co FROM dv)"""
SER = W(RUNS, NEAR, STEP, STITCH)
O["stitched_series"] = SER + "SELECT series, run_index, o_orderkey, time_ps_local, ROUND(off,6) AS time_offset_ps, ROUND(time_ps,6) AS time_ps FROM st"
O["density_concentration"] = SER + """SELECT series, run_index, o_orderkey, ROUND(v,6) AS volume_A3, ROUND(de,6) AS density_g_cm3,
  CAST(12 AS INT) AS count_Li, ROUND(co,6) AS concentration_Li_mol_dm3 FROM dc"""
CUM = """, cm AS (SELECT *, AVG(kinetic_kcal_mol) OVER w AS k_c, AVG(a_A) OVER w AS a_c, AVG(v) OVER w AS v_c, AVG(de) OVER w AS d_c, AVG(co) OVER w AS c_c FROM dc
  WINDOW w AS (PARTITION BY series ORDER BY time_ps, run_index, o_orderkey ROWS UNBOUNDED PRECEDING))"""
O["cumulative_means"] = SER + CUM + """SELECT series, run_index, o_orderkey, ROUND(k_c,4) AS kinetic_kcal_mol_cumavg, ROUND(a_c,4) AS a_A_cumavg,
  ROUND(v_c,4) AS volume_A3_cumavg, ROUND(d_c,4) AS density_g_cm3_cumavg, ROUND(c_c,4) AS concentration_Li_mol_dm3_cumavg FROM cm"""
O["series_summary"] = SER + """SELECT series, COUNT(*) AS n_points, ROUND(MIN(time_ps),4) AS time_min_ps, ROUND(MAX(time_ps),4) AS time_max_ps,
  CAST(12 AS INT) AS count_Li_first, CAST(12 AS INT) AS count_Li_min, CAST(12 AS INT) AS count_Li_max, """ + ", ".join(
    f"ROUND(AVG({c}),4) AS {n}_mean, ROUND(STDDEV_SAMP({c}),4) AS {n}_std, ROUND(AVG({c}),4) AS {n}_last_cumavg"
    for c, n in (("kinetic_kcal_mol", "kinetic_kcal_mol"), ("a_A", "a_A"), ("v", "volume_A3"), ("de", "density_g_cm3"))) + """,
  CAST(SUBSTR(series,2,3) AS DOUBLE) AS target_temperature_K FROM dc GROUP BY series"""
O["kinetic_temperature"] = W(RUNS) + """SELECT series, run_index, time_ps, ROUND(2*kinetic_kcal_mol/(1197*0.00198720425864083::DOUBLE),6) AS temperature_K
  FROM logs WHERE kinetic_kcal_mol IS NOT NULL"""
O["system_mass"] = W(ATOMS) + "SELECT traj, ROUND(SUM(mass),6) AS system_mass_g_mol, COUNT(*) AS n_atoms FROM atoms GROUP BY traj"
O["system_mass_skip"] = W(ATOMS) + """SELECT traj, ROUND(SUM(mass) FILTER (atom_type<>71),6) AS system_mass_g_mol, COUNT(*) AS n_atoms,
  '71' AS missing_types FROM atoms GROUP BY traj"""
O["box_length"] = W(ATOMS) + "SELECT traj, ROUND(CBRT(SUM(mass)/(6.02214076e23*1e-24*1.2)),5) AS box_A FROM atoms GROUP BY traj"

# --- molecules ----------------------------------------------------------------------------------------

O["bond_edges"] = W(BONDED) + "SELECT LEAST(atom_id, prev) AS a, GREATEST(atom_id, prev) AS b FROM bonded WHERE prev IS NOT NULL"
O["components"] = W(BONDED) + "SELECT atom_id, mol_id FROM bonded"
O["entity_counts"] = W(BONDED, "t AS (SELECT mol_id, LIST(DISTINCT atom_type) AS ty FROM bonded GROUP BY mol_id)") + """
SELECT 'Li' AS token, COUNT(*) AS n FROM bonded WHERE atom_type IN (10,11)
UNION ALL SELECT 'chains', COUNT(*) FROM t WHERE list_contains(ty,20) AND list_contains(ty,31)
UNION ALL SELECT 'any_chain', COUNT(*) FROM t WHERE list_contains(ty,20) OR list_contains(ty,31)"""
O["count_consistency"] = W(RUNS) + """SELECT series, token, COUNT(DISTINCT n) AS n_values FROM (
  SELECT series, run_index, 'status' AS token, COUNT(DISTINCT o_orderstatus) AS n FROM runs GROUP BY ALL
  UNION ALL SELECT series, run_index, 'orders', COUNT(*) FROM runs GROUP BY ALL) GROUP BY ALL HAVING COUNT(DISTINCT n)>1"""
O["type_inventory"] = W(BONDED, """nm AS (SELECT atom_type, name, COUNT(*) AS k FROM bonded GROUP BY ALL),
cc AS (SELECT atom_type, COUNT(DISTINCT mol_id) AS m FROM bonded GROUP BY atom_type)""") + """
SELECT atom_type, CAST(SUM(k) AS BIGINT) AS atom_count, STRING_AGG(name||':'||k, ';' ORDER BY name) AS atom_names_and_counts,
  ANY_VALUE(m) AS connected_components_containing_type FROM nm JOIN cc USING (atom_type) GROUP BY atom_type"""
O["missing_types"] = W(BONDED) + """SELECT token, CAST(t AS INT) AS atom_type FROM (VALUES ('odd',10),('odd',99),('odd',53),('fine',20)) v(token,t)
  WHERE t NOT IN (SELECT atom_type FROM bonded)"""
O["topology_check"] = """WITH y AS (SELECT CAST(YEAR(o_orderdate) AS BIGINT) AS frame FROM orders GROUP BY 1),
f AS (SELECT MIN(frame)%2=0 AS flip FROM y)
SELECT frame, (SELECT COUNT(*) FROM orders) AS n_atoms, (SELECT COUNT(*) FROM orders) AS n_atoms_first FROM y, f
WHERE frame<>(SELECT MIN(frame) FROM y) AND (flip OR frame%2=0)"""
O["retag"] = W(BONDED, """fm AS (SELECT mol_id, STRING_AGG(name||k, '' ORDER BY name) AS formula FROM
  (SELECT mol_id, name, COUNT(*) AS k FROM bonded GROUP BY ALL) GROUP BY mol_id),
nb AS (SELECT a.atom_id, b.name AS ne FROM bonded a JOIN bonded b ON a.prev=b.atom_id UNION SELECT b.atom_id, a.name FROM bonded a JOIN bonded b ON a.prev=b.atom_id),
ns AS (SELECT atom_id, LIST(ne) AS near FROM nb GROUP BY atom_id)""") + """
SELECT atom_id, mol_id, name AS element, formula, CAST(CASE WHEN formula='Li1' AND name='Li' THEN 906
  WHEN formula='N1S1' AND name='N' AND list_contains(near,'S') THEN 972 WHEN formula='N1S1' AND name='N' THEN 973
  WHEN formula='N1S1' AND name='S' THEN 974 WHEN formula='H1Li1' AND name='H' AND list_contains(near,'Li') THEN 971 ELSE atom_type END AS INT) AS atom_type
FROM bonded JOIN fm USING (mol_id) LEFT JOIN ns USING (atom_id)"""
O["topology_summary"] = W(ATOMS) + """SELECT 'element' AS kind, element AS value, COUNT(*) AS n FROM atoms GROUP BY ALL
UNION ALL SELECT 'resname', resname, COUNT(*) FROM atoms GROUP BY ALL UNION ALL SELECT 'atom_type', CAST(atom_type AS VARCHAR), COUNT(*) FROM atoms GROUP BY ALL
UNION ALL SELECT 'name', element, COUNT(*) FROM atoms GROUP BY ALL"""
O["residue_summary"] = W(ATOMS) + """SELECT resname, n_atoms, elements, COUNT(*) AS n_residues FROM (SELECT traj, chain, resid, resname,
  COUNT(*) AS n_atoms, STRING_AGG(DISTINCT element, ',' ORDER BY element) AS elements FROM atoms GROUP BY ALL) GROUP BY ALL"""

# --- selection -------------------------------------------------------------------------------------------

O["select_species"] = W(ATOMS) + """SELECT traj, CASE element WHEN 'Li' THEN 'Li' WHEN 'H' THEN 'SOL' ELSE 'FSA' END AS label,
  CASE element WHEN 'Li' THEN 1 WHEN 'H' THEN 0 ELSE -1 END::DOUBLE AS charge,
  MIN(atom_id) OVER (PARTITION BY traj, chain, resid) AS particle_id, atom_id FROM atoms"""
O["select_species_by_type"] = W(ATOMS) + """SELECT traj, 'Li' AS label, 1.0::DOUBLE AS charge, atom_id AS particle_id, atom_id FROM atoms WHERE atom_type=6
UNION ALL SELECT traj, 'NO', -1, atom_id, atom_id FROM atoms WHERE atom_type IN (72,81)
UNION ALL SELECT traj, 'mol', -1, MIN(atom_id) OVER (PARTITION BY traj, resid), atom_id FROM atoms WHERE chain='A'
  AND (traj, resid) IN (SELECT (traj, resid) FROM atoms WHERE atom_type=164)"""
O["select_molecules"] = W(ATOMS) + """SELECT traj, resid*5+1 AS mol_id, atom_id, 'anion' AS target FROM atoms WHERE element IN ('O','S')
UNION ALL SELECT traj, atom_id, atom_id, 'solvent' FROM atoms WHERE element='H'"""
O["select_atoms"] = W(ATOMS) + """SELECT 'key' AS rule, traj, atom_id FROM atoms WHERE resname='FSA'
UNION ALL SELECT 'ion', traj, atom_id FROM atoms WHERE element IN ('Li','H')
UNION ALL SELECT 'element', traj, atom_id FROM atoms WHERE element='O' UNION ALL SELECT 'group', traj, atom_id FROM atoms WHERE chain='A'"""
O["frame_range"] = W(POS, "n AS (SELECT traj, MAX(frame)+1 AS nf FROM pos GROUP BY traj)") + """
SELECT traj, frame, 'ratio' AS rule FROM n, RANGE(CAST(FLOOR(0.25*nf) AS BIGINT), nf, 3) t(frame)
UNION ALL SELECT traj, frame, 'negative' FROM n, RANGE(nf-20, nf-2, 4) t(frame)"""
O["select_frames"] = W(POS) + "SELECT traj, (frame-10)//3 AS frame, SUM(x) AS sx, COUNT(*) AS n FROM pos WHERE frame>=10 AND (frame-10)%3=0 GROUP BY ALL"
from mdframes.schema import ELEMENT_MASS, ELEMENTS  # noqa: E402

EL = "(" + ",".join(f"'{e}'" for e in ELEMENTS) + ")"
ML = "(" + ",".join(f"'{e}'" for e in ELEMENT_MASS) + ")"
O["site_tokens"] = f"""WITH l AS (SELECT *, regexp_replace(p_name,'[^A-Za-z]','','g') AS s,
  UPPER(p_type[1])||LOWER(SUBSTR(p_type,2,10)) AS giv FROM part),
m AS (SELECT *, UPPER(s[1])||LOWER(s[2]) AS two, UPPER(s[1]) AS one FROM l),
e AS (SELECT *, CASE WHEN giv IN {ML} THEN giv WHEN LENGTH(s)>=2 AND two IN {ML} THEN two WHEN one IN {ML} THEN one ELSE 'C' END AS el FROM m)
SELECT p_partkey, CASE WHEN LENGTH(s)>=2 AND two IN {EL} THEN two ELSE UPPER(s) END AS site, el AS element,
  CASE WHEN LENGTH(s)>=2 AND two IN {ML} THEN two ELSE one END AS element_upper,
  CASE el {' '.join(f"WHEN '{k}' THEN {v}" for k, v in ELEMENT_MASS.items())} ELSE 12.011 END::DOUBLE AS mass,
  TRIM(regexp_replace(p_type||': '||p_name,'[^A-Za-z0-9_.+-]+','_','g'),'_') AS label FROM e"""
O["temperature_from_name"] = """SELECT o_orderkey, CASE WHEN o_orderkey%10=0 THEN 273.0 WHEN o_orderkey%4=3 THEN 298.0 ELSE 240+o_orderkey%200 END::DOUBLE AS temperature_K,
  CASE WHEN o_orderkey%10=0 THEN 'map' WHEN o_orderkey%4=3 THEN 'fallback' ELSE 'filename' END AS temperature_source FROM orders"""
O["run_names"] = W(RUNS) + """SELECT o_orderkey, series AS label, CAST(SUBSTR(series,2,3) AS DOUBLE) AS temperature_K, run_index AS run FROM runs"""

# --- files -----------------------------------------------------------------------------------------------

RANKED = "rkd AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY traj, frame ORDER BY atom_id)-1 AS k FROM pos)"
O["ingest_pdb"] = W(POS, RANKED) + "SELECT traj, frame, k AS atom_id, ROUND(x,3) AS x, ROUND(y,3) AS y, ROUND(z,3) AS z FROM rkd"
O["ingest_pdb_frames"] = W(POS) + """SELECT traj, frame, COUNT(*) AS n_atoms, 20.0::DOUBLE AS a, 20.0::DOUBLE AS b, 20.0::DOUBLE AS c,
  90.0::DOUBLE AS alpha, 90.0::DOUBLE AS beta, 90.0::DOUBLE AS gamma FROM pos GROUP BY traj, frame"""
O["ingest_pdb_strict"] = O["ingest_pdb_frames"]
O["ingest_pdb_atoms"] = W(POS, ATOMS) + """SELECT c.chunk, traj, ROW_NUMBER() OVER (PARTITION BY traj, c.chunk ORDER BY atom_id)-1 AS atom_id, element AS name, resname, chain,
  CAST(resid AS INT) AS resid, '' AS icode, element AS site, element, atom_type, mass FROM atoms
  JOIN (SELECT DISTINCT traj, CAST(frame//25 AS INT) AS chunk FROM pos) c USING (traj)"""
O["ingest_xyz"] = W(POS) + """SELECT traj, frame, atom_id+1 AS atom_id, x, y, z, COUNT(*) OVER (PARTITION BY traj, frame) AS n_atoms, 20.0::DOUBLE AS a,
  'frame of '||traj AS title FROM pos"""
O["ingest_xyz_mixed"] = W(POS) + """SELECT traj, frame, atom_id+1 AS atom_id, x, y, z, COUNT(*) OVER (PARTITION BY traj, frame) AS n_atoms,
  CASE WHEN frame%5<3 THEN 20.0::DOUBLE END AS a, 'frame of '||traj AS title FROM pos"""
O["flow_resumed"] = W(POS) + """, ct AS (SELECT traj, frame, COUNT(*) AS n, AVG(ROUND(x,3)) AS x FROM pos GROUP BY traj, frame)
SELECT traj, frame, n, ROUND(x*weight,5) AS x, CAST(CASE WHEN weight=2 THEN 3 WHEN frame<25 THEN 1 ELSE 2 END AS INT) AS call, weight
FROM ct, (SELECT UNNEST([1.0::DOUBLE, 2.0::DOUBLE]) AS weight)"""
O["snapshot_cells"] = W(RUNS) + """SELECT series, run_index, o_orderkey AS frame, o_orderkey*50.0::DOUBLE AS time_ps, ROUND(a_A,6) AS a, b_A AS b, c_A AS c,
  90.0::DOUBLE AS alpha, 90.0::DOUBLE AS beta, 90.0::DOUBLE AS gamma FROM snaps WHERE a_A IS NOT NULL"""
O["ingest_log"] = W(RUNS) + """SELECT series, run_index, time_ps, ROUND(potential_kcal_mol,4) AS potential_kcal_mol, ROUND(kinetic_kcal_mol,4) AS kinetic_kcal_mol,
  20.0::DOUBLE AS a_A, 90.0::DOUBLE AS gamma_deg FROM logs"""
O["kinetic_log"] = W(RUNS) + """SELECT series, run_index, time_ps, ROUND(2*kinetic_kcal_mol/(1197*0.00198720425864083::DOUBLE),6) AS temperature_K,
  CAST(1197 AS INT) AS dof_used FROM logs WHERE kinetic_kcal_mol IS NOT NULL"""
O["ingest_masses"] = "SELECT CAST(p_partkey AS INT) AS atom_type, p_retailprice AS mass FROM part"
DIRS = """fl AS (SELECT *, 'file:/data/'||series||CASE WHEN run_index=1 THEN '' ELSE '_run_00'||run_index END AS directory, 'snap'||o_orderstatus AS prefix FROM runs)"""
O["snapshot_discovery"] = W(RUNS, DIRS, """cn AS (SELECT directory, prefix, ROW_NUMBER() OVER (PARTITION BY directory ORDER BY c DESC, prefix) AS k
  FROM (SELECT directory, prefix, COUNT(*) AS c FROM fl GROUP BY directory, prefix))""") + "SELECT directory, prefix, rn AS index FROM fl JOIN cn USING (directory, prefix) WHERE k=1"
O["source_discovery"] = W(RUNS, DIRS, """cn AS (SELECT directory, prefix, ROW_NUMBER() OVER (PARTITION BY directory ORDER BY c DESC, prefix) AS k
  FROM (SELECT directory, prefix, COUNT(*) AS c FROM fl GROUP BY directory, prefix)),
nm AS (SELECT directory, CASE WHEN o_orderkey%2=0 THEN 0 ELSE 1 END AS r, directory||'/'||prefix||o_orderkey||CASE WHEN o_orderkey%2=0 THEN '.arc' ELSE '.xyz.gz' END AS f
  FROM fl WHERE directory LIKE '%T270K%')""") + """
SELECT directory, COUNT(*) AS n, ARG_MIN(directory||'/'||prefix||'.'||LPAD(CAST(rn AS VARCHAR), GREATEST(3, LENGTH(CAST(rn AS VARCHAR)))::INT, '0'), rn) AS first
FROM fl JOIN cn USING (directory, prefix) WHERE k=1 AND directory NOT LIKE '%T270K%' GROUP BY directory
UNION ALL SELECT directory, COUNT(*), ARG_MIN(f, (r, f)) FROM nm GROUP BY directory"""
O["atom_type_field"] = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  CAST(CASE WHEN l_quantity>1 THEN l_quantity ELSE 3 END AS INT) AS auto,
  CAST(CASE WHEN l_linenumber%3=1 THEN l_quantity ELSE 0 END AS INT) AS bfactor,
  CAST(CASE WHEN l_linenumber%3=2 AND l_quantity>1 THEN l_quantity END AS INT) AS tail FROM lineitem"""


O["atom_type_modes"] = """SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_quantity>1 THEN l_quantity ELSE 3 END AS INT) AS type_auto,
  CAST(CASE WHEN l_linenumber%3=0 THEN l_quantity ELSE 1 END AS INT) AS type_occupancy,
  CAST(CASE WHEN l_linenumber%3=1 THEN l_quantity ELSE 0 END AS INT) AS type_bfactor, CAST(l_suppkey%1000 AS INT) AS type_resname,
  CAST(CASE WHEN l_linenumber%3=2 AND l_quantity>1 THEN l_quantity END AS INT) AS type_tail,
  CAST(CASE WHEN l_quantity>1 THEN l_quantity ELSE 3 END AS INT) AS type_last_int, NULL::INT AS type_none FROM lineitem"""


def g_only(site: str) -> str:
    return W(POS, pairs("p", "('Li')", f"('{site}')")) + rdf_tail(0.5, 12, "pf", cnt("Li", site)) + "SELECT traj, bin, g FROM g"


O["combined_curves"] = f"""SELECT traj, bin, ROUND(n.g,6) AS Li_N, ROUND(o.g,6) AS Li_O, ROUND(s.g,6) AS Li_S FROM ({g_only('N')}) n
JOIN ({g_only('O')}) o USING (traj, bin) JOIN ({g_only('S')}) s USING (traj, bin)"""
O["sink_roundtrip"] = SER + "SELECT series, run_index, o_orderkey, ROUND(v,6) AS volume_A3 FROM dv"
O["csv_roundtrip"] = triplets("1", "a.j<>b.j") + ADF[:ADF.index("SELECT traj, bin, bin*10")].replace("FROM grid LEFT", "FROM grid SEMI JOIN h USING (traj) LEFT") + """
SELECT traj, bin, CASE WHEN tot>0 THEN ROUND(count/(tot*10.0::DOUBLE),6) ELSE 0 END AS density_per_degree, count FROM d"""
O["text_lines"] = W(POS, pairs("p", "('Li')", "('O')")) + rdf_tail(0.5, 12, "tn1*n2/mv", cnt("Li", "O")) + \
    "SELECT traj, printf('%.4f %.4f', r, cn) AS line FROM g"
LAG_TERMS = ["self:Li", "self:FSA", "distinct:Li-Li", "distinct:Li-FSA", "distinct:FSA-FSA", "total:charge"]
O["out_lags"] = ONS + "SELECT traj, lag, ROUND(time,3) AS time, " + ", ".join(
    f"ROUND(MAX(CASE WHEN term='{t}' THEN value END),3)+0.0::DOUBLE AS {t.replace(':', '_').replace('-', '_')}" for t in LAG_TERMS) + " FROM curves GROUP BY ALL"
O["out_decomposition"] = O["onsager_sigma"]
O["out_transference"] = f"SELECT traj, lag, " + ", ".join(
    f"MAX(CASE WHEN ref='{f}' THEN {m} END) AS {m}__{f}" for f in ("barycentric", "solvent_fixed")
    for m in ("PFG_t_app", "eNMR_t0", "Bruce_Vincent_tss")) + f" FROM ({O['transference_running']}) GROUP BY traj, lag"
O["out_blocks"] = O["transference_blocks"]
O["transference_running_blocks"] = W(POS, PARTS, REF, blocks("fref", keep=10), curves("blk", "traj ref block", 15)) + five("traj, ref, block") + f"""
, e AS (SELECT traj, ref, block, name, lag, {expanding('pcv', '', start=0.2).replace('>=8 THEN', '>=4 THEN')} AS s FROM pcv
  WINDOW w AS (PARTITION BY traj, ref, block, name ORDER BY time ROWS UNBOUNDED PRECEDING)),
p5 AS (SELECT traj, ref, block, lag, {PIV} FROM e GROUP BY ALL), tn AS (SELECT *, {TN} FROM p5)
""" + " UNION ALL ".join(f"""SELECT traj, ref, '{q}' AS quantity, lag, ROUND(AVG({q}),4)+0.0::DOUBLE AS mean,
  ROUND(CASE WHEN COUNT({q})>=2 THEN STDDEV_SAMP({q})/2 END,4)+0.0::DOUBLE AS err FROM tn GROUP BY traj, ref, lag""" for q in ("PFG_t_app", "eNMR_t0", "Bruce_Vincent_tss"))
O["out_species_msd"] = O["msd_species"]
O["out_summary_lines"] = f"""SELECT traj, label, 0 AS part, 'n_particles = '||n_particles AS line FROM ({O['ne_conductivity']})
UNION ALL SELECT traj, label, 1, 'concentration_mol_L = '||printf('%.3f', concentration_mol_L) FROM ({O['ne_conductivity']})"""
O["out_kinetic"] = O["kinetic_log"]
O["out_solvent"] = O["solvent_diagnostics"]
O["out_events"] = O["contact_events"]

# --- flows -----------------------------------------------------------------------------------------------
RANGE = """sel AS MATERIALIZED (SELECT p.* FROM pos p JOIN (SELECT traj, CAST(FLOOR(0.2*(MAX(frame)+1)) AS BIGINT) AS s FROM pos GROUP BY traj) USING (traj)
  WHERE frame>=s AND (frame-s)%2=0)"""


def ranged(site: str) -> str:
    return W(POS, RANGE, pairs("p", "('Li')", f"('{site}')", "sel")) + rdf_tail(
        0.5, 12, "pf", cnt("Li", site).replace("FROM pos", "FROM sel")) + f"SELECT 'Li-{site}' AS pair, traj, bin, {r('r g cn')}, count FROM g"


O["flow_radial"] = f"SELECT * FROM ({ranged('O')}) UNION ALL BY NAME SELECT * FROM ({ranged('N')})"
O["flow_residence"] = CON + CONT + INTER + f""", ic AS ({trapz('ct')}), ii AS ({trapz('it')}),
nk AS (SELECT traj, COUNT(DISTINCT atom_id) FILTER (site='Li') AS nc, COUNT(DISTINCT atom_id//5) FILTER (site IN ('N','O','S')) AS nm FROM pos GROUP BY traj),
sm AS (SELECT traj, COUNT(*) AS ne, COUNT(*) FILTER (lc) AS nl, COUNT(*) FILTER (rc) AS nr FROM evt GROUP BY traj)
SELECT traj, nf AS n_frames, nc AS n_cations, nm AS n_molecules, ne AS n_events, nl AS n_left_censored, nr AS n_right_censored,
  ROUND(t/(nf*nc),6) AS mean_coordination, ROUND(ic.integral,6) AS continuous_integral_ns, ROUND(ii.integral,6) AS intermittent_integral_raw_ns,
  6.0::DOUBLE AS r_on, 8.0::DOUBLE AS r_off, 'user' AS cutoff_source FROM len JOIN nk USING (traj) JOIN sm USING (traj) JOIN tot USING (traj)
JOIN ic USING (traj) JOIN ii USING (traj)"""
DRIFT = f"""ctr AS (SELECT traj, frame, SUM(m*ux)/SUM(m) AS cx, SUM(m*uy)/SUM(m) AS cy, SUM(m*uz)/SUM(m) AS cz FROM (SELECT *, {MASSES} AS m FROM pos) GROUP BY traj, frame),
dp AS (SELECT p.* REPLACE (x-cx AS x, y-cy AS y, z-cz AS z) FROM parts p JOIN ctr USING (traj, frame))"""
O["temperature_map"] = """WITH p AS (SELECT o_orderkey, '/d'||(o_orderkey%3)||'/r'||(o_custkey%7)||CASE WHEN o_orderkey%2=0 THEN '.pdb' ELSE '.pdb.gz' END AS path,
  'r'||(o_custkey%7)||CASE WHEN o_orderkey%2=0 THEN '.pdb' ELSE '.pdb.gz' END AS name, 'r'||(o_custkey%7) AS stem FROM orders),
k AS (SELECT *, CASE WHEN path IN ('/d0/r1.pdb','/d1/r3.pdb.gz') THEN path WHEN name IN ('r1.pdb','r2.pdb.gz') THEN name WHEN stem IN ('r2','r3') THEN stem END AS map_key FROM p)
SELECT o_orderkey, path, CASE map_key WHEN '/d0/r1.pdb' THEN 250.0 WHEN 'r1.pdb' THEN 260 WHEN 'r2.pdb.gz' THEN 270 WHEN 'r2' THEN 280 WHEN 'r3' THEN 290
  WHEN '/d1/r3.pdb.gz' THEN 295.5 END::DOUBLE AS temperature_K, map_key FROM k"""
O["ingest_xyz_bonds"] = W(BONDED) + """SELECT atom_id, name, atom_type, COALESCE(prev::VARCHAR, '') AS bonds, COALESCE(prev::VARCHAR, '') AS strict_bonds FROM bonded"""
O["ingest_log_fields"] = W(RUNS) + """, t AS (SELECT series||'/'||run_index AS run, FLOOR(time_ps/20)*20 AS time_ps, CAST(time_ps AS BIGINT)%20 AS f, time_ps AS at,
  potential_kcal_mol AS p, kinetic_kcal_mol AS k FROM logs)
SELECT run, time_ps, ROUND(ARG_MAX(p, f),4) AS potential_kcal_mol, ROUND(ARG_MAX(COALESCE(k, 15), f),4) AS kinetic_kcal_mol, 21.0::DOUBLE AS a_A, 23.0::DOUBLE AS c_A,
  91.0::DOUBLE AS beta_deg FROM t GROUP BY run, time_ps"""
O["ingest_curves"] = """WITH c AS (SELECT ['Li-O','O-Li','N-Li','S-H'][p_size%4+1] AS pair, p_partkey::DOUBLE AS r, ROUND(p_retailprice::DOUBLE,2) AS g_ref FROM part WHERE p_partkey%9<>0)
SELECT 'Li' AS a, 'O' AS b, * FROM c WHERE pair='Li-O' UNION ALL SELECT 'Li', 'N', * FROM c WHERE pair='N-Li'"""
O["flow_joint_states"] = O["coordination_states"]
O["select_by_field"] = "WITH " + ATOMS + """, hit AS (SELECT traj, chain, resid, MIN(atom_id) FILTER (element='N') AS byname, MIN(atom_id) FILTER (resname='FSA') AS byres,
  MIN(atom_id) FILTER (atom_type=72) AS bytype FROM atoms GROUP BY ALL),
long AS (SELECT traj, chain, resid, 'name' AS field, byname AS mol_id FROM hit UNION ALL SELECT traj, chain, resid, 'resname', byres FROM hit UNION ALL SELECT traj, chain, resid, 'atom_type', bytype FROM hit),
info AS (SELECT l.*, COUNT(*) FILTER (a.element IN ('O','S')) AS n FROM long l JOIN atoms a USING (traj, chain, resid) WHERE mol_id IS NOT NULL GROUP BY ALL)
SELECT traj, field, mol_id, atom_id FROM info JOIN atoms USING (traj, chain, resid) WHERE CASE WHEN n>0 THEN element IN ('O','S') ELSE atom_id=mol_id END"""
O["flow_angular"] = f"""SELECT *, 'O-Li-N' AS label FROM ({O['adf']}) UNION ALL SELECT *, 'O-Li-O' FROM ({O['adf_unique_terminals']})"""
O["flow_angular_counters"] = f"SELECT *, 'O-Li-N' AS label FROM ({O['adf_counters']})"
O["flow_diffusion"] = O["msd_species"]
O["frame_times"] = W(POS, RUNS) + """SELECT DISTINCT 'archive' AS kind, traj AS run, frame, 10.0::DOUBLE+frame*50 AS time_ps FROM pos
UNION ALL SELECT 'snapshots', series||'/'||run_index, rn+3, ((MIN(rn+3) OVER (PARTITION BY series, run_index))*50+(rn-MIN(rn) OVER (PARTITION BY series, run_index))*50)::DOUBLE FROM runs"""
O["selected_positions"] = W(POS) + "SELECT traj, frame, atom_id, x, y, z FROM pos WHERE site IN ('O','S')"
O["restored_box"] = W(POS, FRAMES) + """SELECT traj, frame, CASE WHEN frame%3<>0 THEN a ELSE 20 END AS a, b, c, CASE WHEN frame%3<>0 THEN al ELSE 90 END AS alpha,
  be AS beta, CASE WHEN frame%3<>0 THEN ga ELSE 90 END AS gamma FROM fr"""
O["reference_file"] = """SELECT 'file:/data/'||printf('c%06d_reference_rdf_Li_O.txt', MIN(o_custkey)) AS file FROM orders WHERE o_orderkey%5=0"""
O["flow_transport"] = W(POS, PARTS, DRIFT, curves("dp"), """sys AS (SELECT DISTINCT traj, 8000.0::DOUBLE AS volume_A3, 300.0::DOUBLE AS temperature_K FROM pos)""") + SIGMA + """
SELECT traj, ROUND(SUM(pair*mult*10) FILTER (term='total:charge'),3) AS sigma_decomposed_mS_cm,
  ROUND(SUM(pair*mult*10) FILTER (term='total:charge'),3) AS sigma_direct_total_mS_cm FROM sg2 GROUP BY traj"""
O["flow_density"] = SER + """, ml AS (SELECT series, run_index, o_custkey, BOOL_OR(o_orderkey%4=1) AS one, BOOL_OR(o_orderkey%4=2) AS two,
  COUNT(*) FILTER (o_orderkey%4=1) AS a FROM runs GROUP BY ALL),
er AS (SELECT series, run_index, SUM(a)::BIGINT AS a, COUNT(*) FILTER (one) AS m, COUNT(*) FILTER (one AND two) AS b FROM ml GROUP BY ALL),
e2 AS (SELECT series, MIN(a) AS mn, MAX(a) AS mx, MIN(m) AS lm, MAX(m) AS hm, MAX(b) AS hb FROM er GROUP BY series)
SELECT series, COUNT(*) AS n_points, ROUND(MAX(time_ps),3) AS time_max_ps, ROUND(AVG(v),3) AS volume_A3_mean, ROUND(AVG(a_A),3) AS a_A_mean,
  ANY_VALUE(mn) AS count_a_min, ANY_VALUE(mx) AS count_a_max, ANY_VALUE(lm) AS count_m_min, ANY_VALUE(hm) AS count_m_max, ANY_VALUE(hb) AS count_both_max FROM dv JOIN e2 USING (series) GROUP BY series"""
O["flow_transport_selected"] = O["flow_transport"]
O["flow_density_selections"] = W(RUNS, """ml AS (SELECT series, run_index, o_custkey, BOOL_OR(o_orderkey%4=1) AS one, BOOL_OR(o_orderkey%4=2) AS two,
  COUNT(*) FILTER (o_orderkey%4=1) AS a, COUNT(*) FILTER (o_orderkey%4 IN (2,3)) AS b FROM runs GROUP BY ALL),
er AS (SELECT series, run_index, SUM(a)::BIGINT AS a, SUM(b)::BIGINT AS b, COUNT(*) FILTER (one) AS m, COUNT(*) FILTER (one AND two) AS x FROM ml GROUP BY ALL)""") + """
SELECT series, run_index, 'a' AS label, 'a' AS token, 'atom' AS count_mode, '1' AS atom_types, 'any' AS molecule_match, a AS entity_count FROM er
UNION ALL SELECT series, run_index, 'b', 'b', 'atom', '2,3', 'any', b FROM er UNION ALL SELECT series, run_index, 'm', 'm', 'molecule', '1', 'any', m FROM er
UNION ALL SELECT series, run_index, 'both', 'both', 'molecule', '1,2', 'all', x FROM er"""
O["invalid_bonds"] = "SELECT o_orderkey AS atom_id, -o_orderkey-1 AS other FROM orders WHERE o_orderkey%7=0"
