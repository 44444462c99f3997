"""Schemas of the library's tables, as readers and Python stages take them; nothing is inferred."""

from __future__ import annotations

#: A row of an exported listening history but for the URI; what identifies a device or place of the listener is not read.
HISTORY = (
    "ts string, platform string, ms_played long, conn_country string, master_metadata_track_name string,"
    " master_metadata_album_artist_name string, master_metadata_album_album_name string,"
    " reason_start string, reason_end string, shuffle boolean, skipped boolean, offline boolean, incognito_mode boolean,"
    " _corrupt_record string"
)
CATALOG = (
    "id string, external_id string, isrc string, title string, artists array<string>, album string, release_year int,"
    " duration_ms long, norm_key string, variant_type string, variant_tags array<string>, canonical_id string,"
    " audio_hash string, audio_path string, match_method string, match_score double, enrichment string,"
    " play_count long, total_ms_played long, first_played_at timestamp, last_played_at timestamp"
)
LINKS = "track_a string, track_b string, method string, relation string, score double"
STATE = "track_id string, stage string, status string, attempts long, error string, ts timestamp"
VECTORS = "track_id string, model_name string, model_version string, dim int, vector array<float>"
FEATURES = (
    "track_id string, danceability double, energy double, valence double, speechiness double, acousticness double,"
    " instrumentalness double, liveness double, loudness double, tempo double, key int, mode int, time_signature int"
)
JOB = "job_id string, track_id string, path string, format string, outputs array<string>"
RESULT = "job_id string, track_id string, status string, error string"
INTERVAL = "start double, duration double, confidence double"
