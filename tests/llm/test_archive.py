from rebill.llm import archive


def test_revisits_refer_to_the_largest_page(spark, tmp_path):
    big = "é" * 500
    rows = [(1, None, big), (5, "u", big), (3, "u", big), (2, "u", "x" * 999), (4, "u", "x" * 999), (6, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in archive.op3_warc(spark, str(tmp_path)).collect()}
    assert got == {
        1: (1000, "revisit", 5), 3: (1000, "revisit", 5), 5: (1000, "response", None),
        2: (999, "response", None), 4: (999, "response", None), 6: (0, "response", None)}


def test_fields_in_urls_do_not_count_and_records_are_rebuilt(spark, tmp_path):
    big = "x" * 1200
    rows = [
        (1, "http://a/?Refers-To: <urn:page:77>", "small"), (2, "u\r\nWARC-Refers-To: <urn:page:78>\r\nWARC-Payload-Digest: sha1:dead", big),
        (3, "v", big), (None, "w", big), (9, None, None), (9, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(archive.op3_warc(spark, str(tmp_path)).collect(), key=str)
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {(1, "response", None), (2, "revisit", 3), (3, "response", None), (None, "response", None), (9, "response", None)}
    assert len(got) == 6
    path = str(tmp_path / "warc")
    archive.write_archive(pages, path)
    back = {r.page_id: r for r in archive.read_archive(spark, path).collect()}
    assert all(r.sound for r in back.values())
    assert bytes(back[2].payload) == big.encode() and bytes(back[2].record) == back[2].header.encode() + b"\r\n\r\n"
    assert bytes(back[3].record) == back[3].header.encode() + big.encode() + b"\r\n\r\n" and back[3].header.endswith("Content-Length: 1200\r\n\r\n")
    assert "WARC-Date: " in back[3].header and back[2].header.count("\r\n") == 9
    assert archive.op3_warc(spark, str(tmp_path)).limit(0).columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
