import hashlib
import zlib

import numpy as np
import pyarrow as pa

from sparkloom.llm import media


def test_round_trip_and_padding():
    for raw in (b"", b"a", bytes(64), bytes(range(256)) * 3):
        p = media.padded(raw)
        assert len(p) % 64 == 0 and len(p) >= 64 and p.startswith(raw) and not p[len(raw) :].strip(b"\0")
        assert media.wav_read(media.wav_write(p)) == (media.RATE, p)


def test_resampling_matches_upsample_filter_decimate():
    x = np.random.default_rng(1).normal(size=500).astype(np.float32)
    up = np.zeros(len(x) * media.UP, np.float32)
    up[:: media.UP] = x
    h = media._phases()[:, ::-1].T.ravel()
    brute = np.convolve(up, h)[: len(up)][:: media.DOWN]
    got = media.resample(x)
    assert len(got) == -(-len(x) * media.UP // media.DOWN)
    np.testing.assert_allclose(got[: len(brute)], brute[: len(got)], atol=1e-5)


def test_resampled_tone_keeps_its_frequency():
    t = np.arange(8000) / 8000
    y = media.resample(np.sin(2 * np.pi * 500 * t).astype(np.float32))
    peak = np.argmax(np.abs(np.fft.rfft(y[:6000]))) * 6000 / 6000
    assert abs(peak - 500) < 2


def test_hysteresis():
    quiet, loud = np.full((5, media.MELS), -6.0), np.full((3, media.MELS), 1.0)
    assert media.active_spans(np.concatenate([quiet, loud, quiet])) == [(5, 8)]
    assert media.active_spans(quiet) == []


def test_query_columns(spark, tmp_path):
    long = "é" * 70_000
    rows = [(1, None, 1), (2, "", 1), (3, "abc", 1), (4, "abc", 2), (None, long, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, media int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in media.op8_media_audio(spark, str(tmp_path)).collect()}
    for doc_id, text, _ in rows:
        raw = (text or "").encode()
        p = media.padded(raw)
        r = got[doc_id]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(p[-64:]) and r["media_bytes"] == len(p) + 44
        assert r["media_sha256"] == hashlib.sha256(media.wav_write(p)).hexdigest()
    assert got[3]["feature"] == got[4]["feature"] != got[1]["feature"] == got[2]["feature"]
    assert media.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tensors_are_stored_as_fixed_shape_tensors(spark):
    texts = ["x" * 30_000, "", "né" * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in media.media_columns(df).collect():
        stored = media.read_tensors(bytes(r["tensors"]))
        assert stored.schema.field("bands").type == pa.fixed_shape_tensor(pa.float32(), (media.TENSOR_FRAMES, media.MELS))
        rate, samples = media.wav_read(bytes(r["media"]))
        x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
        bands = media.log_mel(media.resample(x), rate * media.UP / media.DOWN)
        values = stored["bands"].combine_chunks().to_numpy_ndarray()
        assert len(values) == r["n_tensors"] == -(-len(bands) // media.TENSOR_FRAMES)
        flat = values.reshape(-1, media.MELS)
        np.testing.assert_array_equal(flat[: len(bands)], bands)
        assert not flat[len(bands) :].any()
        spans = list(zip(stored["start_s"].to_pylist(), stored["end_s"].to_pylist(), strict=True))
        assert all(a < b for a, b in spans) and all(b == c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_log_mel_matches_the_transform_written_out():
    rate = 6000.0
    y = np.random.default_rng(2).normal(size=media.FRAME + media.HOP).astype(np.float32)
    window, bank = media._mel_bank(rate)
    k, n = np.arange(media.FRAME // 2 + 1), np.arange(media.FRAME)
    waves = np.exp(-2j * np.pi * np.outer(k, n) / media.FRAME)
    brute = [np.log10(np.abs(waves @ (y[a : a + media.FRAME] * window)) ** 2 @ bank + 1e-6) for a in (0, media.HOP)]
    np.testing.assert_allclose(media.log_mel(y, rate), brute, atol=1e-3)
