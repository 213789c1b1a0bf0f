"""Declared schemas of the tables read from JSON; parquet tables carry their own."""

from pyspark.sql import types as T

RUN_COUNTS = "STRUCT<counts: ARRAY<BIGINT>, size: ARRAY<INT>>"


RAW_RECORDS = "MAP<STRING, ARRAY<STRUCT<id: STRING, range_nop: ARRAY<INT>>>>"

DATASET_INFO = (
    "codebase_version STRING, robot_type STRING, total_episodes BIGINT, total_frames BIGINT, total_tasks BIGINT, "
    "fps DOUBLE, features MAP<STRING, STRUCT<dtype: STRING, shape: ARRAY<INT>, names: STRING>>"
)

VIEW_META = (
    "demo STRING, view STRING, T INT, Tmin INT, idxs ARRAY<INT>, target STRUCT<name: STRING>, "
    "target_ids ARRAY<INT>, visible_frac DOUBLE, median_px INT"
)

RELATION = (
    "STRUCT<video_id: STRING, video_path: ARRAY<STRING>, "
    "prompt: STRUCT<first_frame_image: STRING, first_frame_anns: MAP<STRING, STRUCT<"
    f"segmentation: {RUN_COUNTS}, area: DOUBLE, category_id: DOUBLE, text: STRING>>>, "
    "objects: MAP<STRING, STRUCT<video_id: STRING, obj_id: INT, crop_caption: STRING, crop_category: STRING, "
    "image_caption: STRING, video_caption: STRING, final_caption: STRING, video_path: ARRAY<STRING>, "
    f"segmentation: {RUN_COUNTS}, area: DOUBLE>>>"
)

POLYGONS = "shapes ARRAY<STRUCT<label: STRING, points: ARRAY<ARRAY<DOUBLE>>>>"

VERDICTS = "id STRING, card STRING, keep_frames ARRAY<INT>, drop_frames ARRAY<INT>, add_frames ARRAY<INT>"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
