"""The corpus stream query writes its drops in as many files as its table has pieces."""

from __future__ import annotations

from millrace.plans import QUERIES, stream_queries


def test_drops_have_the_pieces_of_the_table(spark, sf_dir, monkeypatch):
    files, plain = [], stream_queries.T.corpus_stream

    def counted(session, folder, *rest):
        files.append(len(session.read.text(folder).inputFiles()))
        return plain(session, folder, *rest)

    monkeypatch.setattr(stream_queries.T, "corpus_stream", counted)
    row = QUERIES["stream_corpus"](spark, sf_dir).first()
    pieces = stream_queries.table(spark, sf_dir, "documents").rdd.getNumPartitions()
    assert pieces > 3 and files == [pieces, 2 * pieces] and row["stored"] == row["hashes"]
