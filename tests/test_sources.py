"""Readers on small files, including files cut into many splits."""

import base64
import json
import zlib

import numpy as np
import pytest

from assayloom.sources import chromatograms as ch, lines as ln, records as rc, tables as tb


@pytest.fixture()
def tiny_splits(spark):
    """Splits far smaller than a file, so that line order has to come from the split starts."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def gauss(n=200):
    t = 5 + np.arange(n) * 0.05
    return t, 1000 + 5000 * np.exp(-0.5 * ((t - 9) / 0.3) ** 2)


def same(got, t, y):
    got = got.orderBy("rt").toPandas()
    assert np.allclose(got["rt"], t) and np.allclose(got["y"], y)


def test_line_order_over_splits(spark, tmp_path, tiny_splits):
    p = tmp_path / "a.txt"
    p.write_text("\n".join(f"line {k}" for k in range(500)) + "\n")
    got = ln.read_lines(spark, str(p))
    assert got.rdd.getNumPartitions() > 3
    assert [r["line"] for r in got.orderBy(*ln.ORDER).collect()] == [f"line {k}" for k in range(500)]


@pytest.mark.parametrize("sep,comma", [(",", False), (";", True), ("\t", False), ("|", False), (" ", False)])
def test_delimiters(spark, tmp_path, sep, comma):
    t, y = gauss()
    num = lambda v: f"{v:.6f}".replace(".", ",") if comma else f"{v:.6f}"
    (tmp_path / "run1.csv").write_text("\n".join(f"{num(a)}{sep}{num(b)}" for a, b in zip(t, y)))
    same(ch.read_delimited_signals(spark, str(tmp_path)), t, y)


def test_seconds_are_found(spark, tmp_path):
    t, y = gauss()
    (tmp_path / "a.txt").write_text("Time (s)\tTIC\n" + "\n".join(f"{a * 60:.4f}\t{b:.4f}" for a, b in zip(t, y)))
    same(ch.read_delimited_signals(spark, str(tmp_path)), t, y)


def test_sections_over_splits(spark, tmp_path, tiny_splits):
    t, y = gauss()
    text = ["[Header]", "Data File Name\tx.qgd", "", "[MS Chromatogram]", "m/z\tTIC", "Interval(msec)\t300", "Ret.Time\tAbsolute Intensity\tRelative Intensity"]
    text += [f"{a * 1000:.3f}\t{b:.3f}\t1.0" for a, b in zip(t, y)] + ["", "[MS Peak Table]", "# of Peaks\t2", "Peak#\tRet.Time\tArea\tHeight\tName"]
    text += ["1\t9000\t120\t50\tLimonene", "2\t9500\t60\t20\tLinalool"]
    (tmp_path / "s1.txt").write_text("\r\n".join(text))
    signal, peaks, meta = ch.read_sectioned_text(spark, str(tmp_path), "min_x1000")
    same(signal, t, y)
    assert [(r["rt"], r["area"], r["name"]) for r in peaks.orderBy("rt").collect()] == [(9.0, 120.0, "Limonene"), (9.5, 60.0, "Linalool")]
    assert {r["key"]: r["value"] for r in meta.collect()}["data file name"] == "x.qgd"


def test_lines_of_one_split_are_dealt(spark, tmp_path, monkeypatch):
    """A split is more than one block, and the header is not copied to every cell."""
    monkeypatch.setattr(ln, "_BLOCK", [*ln.ORDER[:2], "pos div 16"])
    (tmp_path / "m.csv").write_text("Sample," + ",".join(f"f{k}" for k in range(40)) + "\n" + "".join(f"s{r}," + ",".join(str(r * k) for k in range(40)) + "\n" for r in range(100)))
    lines = ln.read_lines(spark, str(tmp_path)).withColumn("_one", ln.F.lit(1))
    assert ln.given_blocks(lines, ln._BLOCK).select("_order_block").distinct().count() == 7 and len(ln._BLOCK) == 3
    assert [r["n"] for r in ln.along_lines(lines, ["document"], {"n": ("sum", "_one")}).orderBy(*ln.ORDER).collect()] == list(range(1, 102))
    got = ch.read_feature_matrix(spark, str(tmp_path))
    assert {(r["sample"], r["feature"]): r["value"] for r in got.collect()} == {(f"s{r}", f"f{k}"): float(r * k) for r in range(100) for k in range(40)}


def test_feature_matrix_transposed(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Compound,s1,s2,s3\nLimonene,1,2,x\nLinalool,4,-,6\nCoumarin,5,6,x\n")
    got = {(r["sample"], r["feature"]): r["value"] for r in ch.read_feature_matrix(spark, str(tmp_path)).collect()}
    assert got[("s1", "Limonene")] == 1.0 and got[("s2", "Linalool")] == 0.0


def b64(values, dtype, pack):
    raw = np.asarray(values, dtype).tobytes()
    return base64.b64encode(zlib.compress(raw) if pack else raw).decode()


def test_mzml(spark, tmp_path):
    cv = lambda a, v="", u="": f'<cvParam accession="{a}" value="{v}" unitName="{u}"/>'
    spec = lambda t, level, body: f"<spectrum>{cv('MS:1000511', level)}{body}<scanList><scan>{cv('MS:1000016', t, 'second')}</scan></scanList></spectrum>"
    arr = lambda v, d, acc, pack: f"<binaryDataArrayList><binaryDataArray>{cv(acc)}{cv('MS:1000515')}{cv('MS:1000574') if pack else ''}<binary>{b64(v, d, pack)}</binary></binaryDataArray></binaryDataArrayList>"
    (tmp_path / "a.mzML").write_text("<mzML><run><spectrumList>" + spec(60, 1, cv("MS:1000285", 5)) + spec(120, 1, arr([1, 2], "<f8", "MS:1000523", True)) + spec(180, 1, arr([4, 2.5], "<f4", "MS:1000521", False))
                                     + spec(200, 2, cv("MS:1000285", 99)) + "</spectrumList></run></mzML>")
    chart = "".join(f"<binaryDataArray>{cv('MS:1000523')}{cv(acc, '', unit)}<binary>{b64(v, '<f8', False)}</binary></binaryDataArray>" for acc, unit, v in (("MS:1000595", "minute", [1, 2, 3]), ("MS:1000515", "", [7, 8, 9])))
    (tmp_path / "b.mzML").write_text("<mzML><run><spectrumList>" + spec(60, 1, cv("MS:1000285", 5)) + f'</spectrumList><chromatogramList><chromatogram id="TIC"><binaryDataArrayList>{chart}</binaryDataArrayList></chromatogram></chromatogramList></run></mzML>')
    got = {(r["sample"], r["rt"]): r["y"] for r in ch.read_mzml_tic(spark, str(tmp_path)).collect()}
    assert got == {("a", 1.0): 5.0, ("a", 2.0): 3.0, ("a", 3.0): 6.5, ("b", 1.0): 7.0, ("b", 2.0): 8.0, ("b", 3.0): 9.0}


def test_mzxml(spark, tmp_path):
    scan = lambda t, level, extra, v: f'<scan msLevel="{level}" retentionTime="{t}"{extra}><peaks precision="32" compressionType="none">{b64(v, ">f4", False)}</peaks></scan>'
    (tmp_path / "a.mzXML").write_text("<mzXML><msRun>" + scan("PT60S", 1, ' totIonCurrent="11"', [1, 1]) + scan("PT2M", 1, "", [50, 3, 60, 4]) + scan("PT3M", 2, "", [1, 1]) + scan("bad", 1, "", [1, 1]) + "</msRun></mzXML>")
    got = {(r["rt"], r["y"]) for r in ch.read_mzxml_tic(spark, str(tmp_path)).collect()}
    assert got == {(1.0, 11.0), (2.0, 7.0)}


def test_mzxml_minutes_stay_as_written(spark, tmp_path):
    """Times that differ in the last digit are two points: minutes are not turned into seconds and back."""
    a = next(x for x in (k / 1000 + 0.0007 for k in range(1, 5000)) if x * 60 / 60 != x)
    scan = lambda t, v: f'<scan msLevel="1" retentionTime="{t}" totIonCurrent="{v}"></scan>'
    (tmp_path / "a.mzXML").write_text("<mzXML><msRun>" + scan(f"PT{a * 60!r}S", 1) + scan(f"PT{a!r}M", 2) + "</msRun></mzXML>")
    assert {(r["rt"], r["y"]) for r in ch.read_mzxml_tic(spark, str(tmp_path)).collect()} == {(a * 60 / 60, 1.0), (a, 2.0)}


def test_xml_chunks_follow_one_another(spark, tmp_path, monkeypatch):
    """Of equal times the first scan counts, also when a sample's scans fill many files."""
    from assayloom.plans import files
    monkeypatch.setattr(files, "XML_CHUNK", 10)
    monkeypatch.setattr(files, "scratch_path", lambda spark, name: str(tmp_path / name))
    rows = [(f"S{s}", 7 * k - 50, f'<scan msLevel="1" retentionTime="PT{k % 5}M" totIonCurrent="{k}"></scan>') for s in range(2) for k in range(200)]
    path = files._xml_files(spark, spark.createDataFrame(rows, "sample string, seq long, line string").repartition(7), "x", "mzXML")
    got = {(r["sample"], r["rt"]): r["y"] for r in ch.read_mzxml_tic(spark, path, "sample").collect()}
    assert got == {(f"S{s}", float(k)): float(k) for s in range(2) for k in range(5)}


@pytest.mark.parametrize("size", ["61", "700", "100000"])
def test_xml_files_are_split(spark, tmp_path, size):
    """The same points wherever the splits fall: inside tags, attributes and closing tags."""
    cv = lambda a, v="", u="": f'<cvParam cvRef="MS" accession="{a}" value="{v}" unitName="{u}" />'
    head = '<?xml version="1.0" encoding="utf-8"?>\n<indexedmzML><mzML>\n<run id="r"><spectrumList count="60" defaultDataProcessingRef="x">\n'
    rows = [f'  <spectrum index="{k}"\n id="scan={k}" defaultArrayLength="0">\n{cv("MS:1000511", 1 + k % 2)}{cv("MS:1000285", k + 1)}<scanList><scan>'
            f'{cv("MS:1000016", k / 4, "minute")}</scan></scanList>\n  </spectrum>\n' for k in range(60)] + ['<spectrum index="60" id="scan=60"/>\n']
    tail = '</spectrumList></run></mzML><indexList count="1"><index name="spectrum"><offset idRef="scan=0">99</offset></index></indexList></indexedmzML>'
    (tmp_path / "a.mzML").write_text(head + "".join(rows) + tail)
    inner = lambda k: f'<scan num="{k}b" msLevel="2" retentionTime="PT{k}S" totIonCurrent="9"><scanOrigin parentFileID="f" num="{k}"/><peaks></peaks></scan>'
    scans = [f'<scan num="{k}" msLevel="1" retentionTime="PT{k * 15}S" totIonCurrent="{k + 1}">\n<peaks></peaks>{inner(k)}</scan>\n' for k in range(60)]
    (tmp_path / "a.mzXML").write_text("\n<mzXML><msRun>" + "".join(scans) + "</msRun></mzXML>")
    old = {c: spark.conf.get(f"spark.sql.files.{c}") for c in ("maxPartitionBytes", "openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        pieces = ch._pieces(spark, str(tmp_path), "spectrum", None, "*.mzML", False)
        assert pieces.rdd.getNumPartitions() > 3 or size == "100000"
        got = {(r["sample"], r["rt"], r["y"]) for r in ch.read_mzml_tic(spark, str(tmp_path), glob="*.mzML").collect()}
        assert got == {("a", k / 4, k + 1.0) for k in range(0, 60, 2)}
        got = {(r["sample"], r["rt"], r["y"]) for r in ch.read_mzxml_tic(spark, str(tmp_path), glob="*.mzXML").collect()}
        assert got == {("a", k / 4, k + 1.0) for k in range(60)}
    finally:
        for c, v in old.items():
            spark.conf.set(f"spark.sql.files.{c}", v)


def test_read_all_keeps_going(spark, tmp_path):
    t, y = gauss()
    for d in ("Asli", "Tiruan"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "run.csv").write_text("\n".join(f"{a:.6f},{b:.6f}" for a, b in zip(t, y)))
    (tmp_path / "junk.txt").write_text("nothing here")
    (tmp_path / "empty.mzML").write_text("<mzML><run></run></mzML>")
    (tmp_path / "ok.mzXML").write_text('<mzXML><msRun><scan msLevel="1" retentionTime="PT60S" totIonCurrent="1"></scan></msRun></mzXML>')
    got = ch.read_all(spark, str(tmp_path))
    assert {r["sample"] for r in got.signals.select("sample").distinct().collect()} == {"run (Asli)", "run (Tiruan)", "ok"}
    assert got.skipped.count() == 2 and got.features.count() == 0


def test_read_all_lists_files_in_batches(spark, tmp_path):
    t, y = gauss()
    text = "\n".join(f"{a:.6f},{b:.6f}" for a, b in zip(t, y))
    for d in ("Asli", "Tiruan", "a[1]/deep", "a[1]/deeper", "_hidden", "k=1"):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "run.csv").write_text(text)
    (tmp_path / ".lock.csv").write_text(text)
    (tmp_path / "junk.txt").write_text("nothing here")
    (tmp_path / "empty.mzML").write_text("<mzML><run></run></mzML>")
    (tmp_path / "ok.mzXML").write_text('<mzXML><msRun><scan msLevel="1" retentionTime="PT60S" totIonCurrent="1"></scan></msRun></mzXML>')
    batches = list(tb.file_batches(spark, str(tmp_path), 2))
    assert len(batches) >= 4 and list(tb.file_batches(spark, str(tmp_path), 100)) == [[str(tmp_path)]]
    listed = [[r["path"] for r in tb.list_inputs(spark, str(tmp_path), paths=b).collect()] for b in batches]
    assert max(map(len, listed)) <= 2 and len(sum(listed, [])) == 8
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    whole, parts = ch.read_all(spark, str(tmp_path)), ch.read_all(spark, str(tmp_path), batch_files=5)
    assert {r["sample"] for r in parts.signals.select("sample").distinct().collect()} >= {"run (Asli)", "run (Tiruan)", "run (k=1)", "ok"}
    for part in ("signals", "peaks", "features", "skipped"):
        assert rows(getattr(whole, part)) == rows(getattr(parts, part))
    assert parts.skipped.count() == 2
    (tmp_path / "nothing").mkdir()
    with pytest.raises(FileNotFoundError):
        ch.read_all(spark, str(tmp_path / "nothing"))


def test_logs_and_poses(spark, tmp_path, tiny_splits):
    (tmp_path / "l.log").write_text("mode | affinity\n1 9.9\n-----+------------+----------+----------\n" + "".join(f"{k}   {-9 + k / 100}   {k}.0  {k}.5\n" for k in range(1, 60)) + "Writing output ... done.\n")
    got = rc.read_score_logs(spark, str(tmp_path)).orderBy("mode").collect()
    assert len(got) == 59 and got[0]["affinity"] == pytest.approx(-8.99) and got[58]["rmsd_ub"] == 59.5
    d = tmp_path / "p"
    d.mkdir()
    atom = lambda n, x: f"ATOM  {1:>5} {n:<4} LIG A   1    {x:8.3f}{0:8.3f}{0:8.3f}  1.00  0.00    +0.000 C "
    (d / "p.pdbqt").write_text("\n".join([atom("C9", 9)] + [line for m in (1, 2, 3) for line in (f"MODEL {m}", atom("C1", m), atom("Cl2", m + 0.5), "ENDMDL")]))
    got = rc.read_pose_atoms(spark, str(d)).orderBy("model", "x").collect()
    assert [(r["model"], r["x"]) for r in got] == [(m, x) for m in (1, 2, 3) for x in (m, m + 0.5)]


def test_contact_tables(spark, tmp_path):
    head = "Category\tTypes\tFrom\tFrom Chemistry\tTo\tTo Chemistry"
    (tmp_path / "named.tsv").write_text(head + "\nH\tConv\tA:SER195:OG\td\tX:LIG1:C0\ta\n\t\t\t\t\t\nH\tConv\tbad\td\tX:LIG1:C0\ta\n")
    (tmp_path / "only_head.tsv").write_text(head + "\n")
    (tmp_path / "bare.tsv").write_text("n\tY\tg\tp\t3.1\tH\tPi\tA:PHE330\td\tX:LIG1:C0\ta\n")
    got = sorted(((r["document"], r["type_subtype"], r["error"], r["from_spec"] and r["from_spec"]["resname"]) for r in rc.read_interactions(spark, str(tmp_path)).collect()), key=str)
    assert got == [("bare", "Pi", None, "PHE"), ("named", "Conv", "atom not understood", None), ("named", "Conv", None, "SER")]


def test_table_errors(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        tb.read_admet(spark, str(tmp_path / "t.csv"))
    (tmp_path / "g.csv").write_text("sample,x\na,1\n")
    with pytest.raises(ValueError):
        tb.read_sample_groups(spark, str(tmp_path / "g.csv"))
    (tmp_path / "l.csv").write_text("carbon,rt\n10,1\n11,2\n")
    with pytest.raises(ValueError):
        tb.read_alkane_ladder(spark, str(tmp_path / "l.csv"))


def test_row_numbers_over_splits(spark, tmp_path, tiny_splits):
    (tmp_path / "r.csv").write_text("PDB Code,center_x\n" + "".join(f"1abc,{k}\n" for k in range(300)))
    got = tb.read_receptors(spark, str(tmp_path / "r.csv")).orderBy("row_index").collect()
    assert [r["center_x"] for r in got] == [float(k) for k in range(300)] and got[1]["receptor"] == "1ABC_R002"


def test_records_over_many_splits_of_one_file(spark, tmp_path, tiny_splits):
    """A file far longer than a split gives the same records, whatever their layout."""
    records = [{"ligand_name": f"L{k}", "receptor_key": "R{1", "replicate": k, "seed": k, "poses": [{"mode": 1, "affinity": -k / 10, "rmsd_lb": 0.0, "rmsd_ub": 0.0}],
                "error": None} for k in range(60)]
    for layout in (None, 2):
        folder = tmp_path / f"layout{layout}"
        folder.mkdir()
        text = "\n".join(json.dumps(r, indent=layout) for r in records[:30]) + "\n{ broken\n" + "\n".join(json.dumps(r, indent=layout) for r in records[30:])
        (folder / "all.json").write_text("\ufeff" + text)
        df = rc.read_run_checkpoints(spark, str(folder))
        got = sorted((r.ligand, r.receptor, r.replicate, r.poses[0].affinity) for r in df.collect())
        assert got == sorted((r["ligand_name"], r["receptor_key"], r["replicate"], r["poses"][0]["affinity"]) for r in records)
    assert ln.read_lines(spark, str(folder), glob="*.json").rdd.getNumPartitions() > 3


def test_plain_records_are_not_shuffled(spark, tmp_path, tiny_splits):
    """A newline and a brace cut UTF-8 files into records; other files take the way over lines and give the same."""
    record = lambda k, receptor="R": json.dumps({"ligand_name": f"L{k}", "receptor_key": receptor, "replicate": k, "poses": [{"mode": 1, "affinity": 1.0}]}, indent=2, ensure_ascii=False)
    text = "\r\n".join(record(k) for k in range(40))
    for name, data in (("utf8", text.encode("utf-8-sig")), ("utf16", text.encode("utf-16")), ("cp1252", (text + "\n" + record(40, "\xb5")).encode("cp1252")), ("late", ("\n  " + text).encode()),
                       ("twice", (text + "\n{{" + record(50)[1:]).encode()), ("headless", (record(51)[1:] + "\n" + text).encode())):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a.json").write_bytes(data)
        df = rc.read_run_checkpoints(spark, str(folder))
        assert sorted(r.replicate for r in df.collect()) == list(range(41 if name == "cp1252" else 40)), name
        assert ("Exchange" not in df._jdf.queryExecution().executedPlan().toString()) == (name == "utf8")


def test_runs_and_sidecars_in_indented_files(spark, tmp_path):
    import json
    from assayloom.sources import records as rc
    pose = {"mode": 1, "affinity": -7.5, "rmsd_lb": 0.0, "rmsd_ub": 0.0}
    run = {"ligand_name": "A", "receptor_key": "R1", "replicate": 2, "seed": 43, "poses": [pose], "output_pdbqt": None, "log_path": None, "error": None}
    (tmp_path / "state").mkdir()
    (tmp_path / "state" / "a.json").write_text(json.dumps(run, indent=2))
    (tmp_path / "state" / "b.json").write_text(json.dumps(run | {"ligand_name": "B", "error": "failed"}, indent=2))
    (tmp_path / "state" / "c.json").write_text('{"ligand_name": "C",')
    got = rc.read_run_checkpoints(spark, str(tmp_path / "state")).collect()
    assert [(r.ligand, r.receptor, r.replicate, r.poses[0].affinity) for r in got] == [("A", "R1", 2, -7.5)]
    side = {"ligand_name": "A", "ligand_code": "", "ligand_chain": "X", "ligand_resname": "LIG", "is_native": True}
    (tmp_path / "out" / "4XYZ").mkdir(parents=True)
    (tmp_path / "out" / "4XYZ" / "A best.json").write_text(json.dumps(side, indent=2))
    (tmp_path / "out" / "4XYZ" / "A best.pdb").write_text("END\n")
    got = rc.read_complex_sidecars(spark, str(tmp_path / "out")).collect()
    assert [(r.receptor, r.complex, r.ligand_resname, r.is_native) for r in got] == [("4XYZ", "A best", "LIG", True)]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "cp1252"])
def test_lines_in_other_encodings(spark, tmp_path, encoding):
    from assayloom.sources.lines import ORDER, read_lines
    lines = ["Ret.Time;Höhe", "1,5;20", "", "2,5;µ30"]
    (tmp_path / "x.txt").write_bytes("\r\n".join(lines).encode(encoding))
    got = [r.line for r in read_lines(spark, str(tmp_path)).orderBy(*ORDER).collect()]
    assert got == lines


def test_line_edges_are_as_the_pattern_has_them(spark):
    """Only lines that may need it go the long way, which is kept out of generated code; none comes out otherwise."""
    from pyspark.sql import functions as F
    from assayloom.sources.lines import _text_of, decoded
    lines = ["", "a", "a\r", "a\r\r", "\r", "\ufeffa\r", "a\ufeff", "a\r\x85", "a\r\u2028", "a\rb", "é\u2029", "\r\u2029"]
    df = spark.createDataFrame([(x,) for x in lines], "value string").repartition(1)
    got = df.select(_text_of(F.col("value")).alias("a"), F.regexp_replace(decoded(F.col("value")), "^\ufeff|\r$", "").alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]


def test_doubled_quotes_and_numbers(spark):
    from pyspark.sql import functions as F
    from assayloom.functions.text import read_number
    from assayloom.sources.chromatograms import _cells
    df = spark.createDataFrame([('a,"say ""hi"", x",2',)], "line string")
    assert df.select(_cells(F.col("line"), F.lit(",")).alias("c")).first().c == ["a", 'say "hi", x', "2"]
    rows = spark.createDataFrame([(x,) for x in ("1f", "0.2d", " 1.5 ", "-inf", "nan", "", "1e3", "['-']", ".5")], "t string")
    assert [r[0] for r in rows.select(read_number("t")).collect()] == [None, None, 1.5, float("-inf"), None, None, 1000.0, None, 0.5]


def test_xml_elements_are_parsed_once(spark, tmp_path):
    """A filter pushed below the parsed columns would run the parser again for every column it names."""
    (tmp_path / "a.mzML").write_text("<mzML><spectrum></spectrum></mzML>")
    (tmp_path / "a.mzXML").write_text("<mzXML><scan></scan></mzXML>")
    for read, glob, scans in ((ch.read_mzml_tic, "*.mzML", 3), (ch.read_mzxml_tic, "*.mzXML", 1)):
        plan = read(spark, str(tmp_path), glob=glob)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_xml(") == scans and not any("from_xml(" in line for line in plan.splitlines() if "Filter" in line)
