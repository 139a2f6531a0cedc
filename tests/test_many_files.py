"""Many CSV files in one scan."""

import gzip

from remuneria.sources import many_files as MF


def test_orders_reasons_and_one_scan(spark, tmp_path):
    for i in range(60):
        order = ["PERIODO", "SECTOR", "CANTIDAD", "OTRA"]
        order = order[i % 4:] + order[:i % 4]
        row = {"PERIODO": f"2024{i:02d}", "SECTOR": '"A, B"', "CANTIDAD": str(i), "OTRA": "z"}
        (tmp_path / f"P_{1960 + i}.csv").write_text(",".join(order).lower() + "\n" + ",".join(row[c] for c in order) + "\n")
    (tmp_path / "P_x.csv").write_text("PERIODO,SECTOR,CANTIDAD\n1,2,3\n")
    (tmp_path / "P_2100.csv").write_text("")
    (tmp_path / "P_2101.csv").write_text("a,b\n1,2\n")
    (tmp_path / "P_2102.csv").write_text("PERIODO, SECTOR \n1,2\n")
    (tmp_path / "P_2103.csv").write_text(",".join(["PERIODO", "SECTOR", "CANTIDAD"] + [f"x{i}" for i in range(20)]) + "\n")
    (tmp_path / "P_2104.csv.gz").write_bytes(gzip.compress(b"PERIODO,SECTOR,CANTIDAD\n1,2,3\n")[:12])
    (tmp_path / "P_2105.csv").write_text("PERIODO,SECTOR,CANTIDAD\n")
    (tmp_path / "P_2106.csv").write_text("SECTOR,PERIODO,CANTIDAD,SECTOR\ns,p\n,q,7,t,u\n")
    rows, refused = MF.read_by_name(spark, f"{tmp_path}/P_*", ["PERIODO", "SECTOR", "CANTIDAD"], "PERIODO", max_columns=12)
    got = sorted((r.year, r.PERIODO, r.SECTOR, r.CANTIDAD) for r in rows.collect())
    assert got == sorted([(1960 + i, f"2024{i:02d}", "A, B", str(i)) for i in range(60)] + [(2106, "p", "s", None), (2106, "q", None, "7")],
                         key=lambda r: (r[0], r[1]))
    why = {r.path.rsplit("/", 1)[1]: r.reason for r in refused.collect()}
    assert why == {"P_x.csv": "no year in the path", "P_2101.csv": "no header", "P_2104.csv.gz": "unreadable",
                   "P_2102.csv": "columns missing: CANTIDAD", "P_2103.csv": "more than 12 columns"}
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan csv") == 1


def test_only_needed_places_are_parsed(spark, tmp_path):
    (tmp_path / "P_1.csv").write_text("X,PERIODO,CANTIDAD\nPERIODO of,a,1\n\n  \nb,c,2,d,e,f\n")
    (tmp_path / "P_2.csv").write_text('CANTIDAD,PERIODO\n5,"p, q"\nz,y,x,w, periodo \n')   # a second header further right
    rows, refused = MF.read_by_name(spark, f"{tmp_path}/P_*", ["PERIODO", "CANTIDAD"], "PERIODO")
    assert sorted((r.year, r.PERIODO, r.CANTIDAD) for r in rows.collect()) == [(1, "a", "1"), (1, "c", "2"), (2, "p, q", "5")]
    assert refused.count() == 0
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "c4:string" in plan and "c5:string" not in plan
