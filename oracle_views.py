"""The canonical views of ``mdframes.views`` written for DuckDB, as CTE texts."""

POS = """
ev AS (SELECT user_id AS atom_id, user_id//100 AS g, event_id, CAST(ROUND(value*100) AS BIGINT) AS v,
  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
  COUNT(*) OVER (PARTITION BY user_id) AS n_atom,
  ts FROM events),
st AS (SELECT *, MAX(n_atom) OVER (PARTITION BY g) AS n_frames,
  SUM(v%385-192) OVER w AS sx, SUM((event_id*7919)%385-192) OVER w AS sy,
  SUM((event_id*104729+v)%385-192) OVER w AS sz
  FROM ev WINDOW w AS (PARTITION BY atom_id ORDER BY ts, event_id)),
walk AS (SELECT 'sys'||g AS traj, u.f AS frame, atom_id,
  ((atom_id*811)%1280+sx)/64.0::DOUBLE AS x, ((atom_id*1319)%1280+sy)/64.0::DOUBLE AS y,
  ((atom_id*1777)%1280+sz)/64.0::DOUBLE AS z
  FROM st, UNNEST(RANGE(n-1, CASE WHEN n=n_atom THEN n_frames ELSE n END)) AS u(f)),
pos AS MATERIALIZED (SELECT traj, frame, atom_id,
  CASE atom_id%5 WHEN 0 THEN 'Li' WHEN 1 THEN 'N' WHEN 2 THEN 'O' WHEN 3 THEN 'S' ELSE 'H' END AS site,
  x-20*FLOOR(x/20) AS x, y-20*FLOOR(y/20) AS y, z-20*FLOOR(z/20) AS z,
  x AS ux, y AS uy, z AS uz FROM walk)"""

ATOMS = """
atoms AS (SELECT DISTINCT 'sys'||(user_id//100) AS traj, user_id AS atom_id,
  CASE user_id%5 WHEN 0 THEN 'Li' WHEN 1 THEN 'N' WHEN 2 THEN 'O' WHEN 3 THEN 'S' ELSE 'H' END AS element,
  CASE user_id%5 WHEN 0 THEN 6.94 WHEN 1 THEN 14.007 WHEN 2 THEN 15.999 WHEN 3 THEN 32.06 ELSE 1.008 END::DOUBLE AS mass,
  CASE user_id%5 WHEN 0 THEN 'LI' WHEN 4 THEN 'SOL' ELSE 'FSA' END AS resname,
  CASE user_id%5 WHEN 0 THEN 'L' WHEN 4 THEN 'S' ELSE 'A' END AS chain,
  user_id//5 AS resid,
  CASE user_id%5 WHEN 0 THEN 6 WHEN 1 THEN 72 WHEN 2 THEN 81 WHEN 3 THEN 164 ELSE 71 END AS atom_type
  FROM events)"""

RUNS = """
runs AS (SELECT *, 'T'||(240+30*CAST(SUBSTR(o_orderpriority,1,1) AS INT))||'K' AS series,
  CAST(1+o_orderkey%3 AS INT) AS run_index,
  ROW_NUMBER() OVER (PARTITION BY o_orderpriority, o_orderkey%3 ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders),
logs AS (SELECT series, run_index, 10.0::DOUBLE*rn AS time_ps, -o_totalprice AS potential_kcal_mol,
  CASE WHEN o_orderkey%13<>0 THEN FLOOR(o_totalprice)/128.0::DOUBLE END AS kinetic_kcal_mol FROM runs),
snaps AS (SELECT series, run_index, o_orderkey, 10.0::DOUBLE*rn + o_orderkey%11 - 5 AS time_ps,
  CASE WHEN o_orderkey%17<>0 THEN 20.0::DOUBLE + (o_custkey%100)/1024.0::DOUBLE END AS a_A,
  20.0::DOUBLE AS b_A, 20.0::DOUBLE AS c_A, 90.0::DOUBLE AS alpha_deg, 90.0::DOUBLE AS beta_deg,
  90.0::DOUBLE AS gamma_deg FROM runs)"""

BONDED = """
bonded AS (SELECT o_custkey, o_orderkey AS atom_id,
  CAST(SUBSTR(o_orderpriority,1,1) AS INT) AS kind,
  ['Li','N','O','S','H'][CAST(SUBSTR(o_orderpriority,1,1) AS INT)] AS name,
  CAST(CAST(SUBSTR(o_orderpriority,1,1) AS INT)*10 + o_orderkey%3 AS INT) AS atom_type,
  LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev,
  MIN(o_orderkey) OVER (PARTITION BY o_custkey) AS mol_id FROM orders)"""
