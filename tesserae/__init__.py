"""PySpark-native analytics over still-image containers and bitstreams.

The names below are the public surface: scans and sinks, DataFrame operators (a row per file, chunk, frame, pixel or plane),
and the functions on single files that their kernels run.

Kernels travel to the executors by value, so these need not have the package.
"""

import sys

from pyspark import cloudpickle

from .operators.alpha import decode_plane, decode_planes
from .operators.container import is_webp, riff_status
from .operators.demux import Limits, demux, describe, parse
from .operators.errors import CATEGORIES, ImageError, category
from .operators.mux import Still, encode_static, mux_stills, remux, remux_files
from .operators.vp8_frame import decode_frame, decode_frames, write_frame
from .operators.vp8_header import read_headers
from .operators.vp8_tables import Tables, read_tables
from .operators.vp8l import decode_files, decode_static, scan_streams, write_stream
from .sources.files import compare, comparison, image_files, manifest, manifest_lines, pam, sink, verify_manifest, write_manifest

__all__ = [
    "CATEGORIES", "ImageError", "Limits", "Still", "Tables", "category", "compare", "comparison", "decode_files", "decode_frame", "decode_frames", "decode_plane", "decode_planes", "decode_static", "demux", "describe", "encode_static",
    "image_files", "is_webp", "manifest", "manifest_lines", "mux_stills", "pam", "parse", "read_headers", "read_tables", "remux", "remux_files", "riff_status", "scan_streams", "sink", "verify_manifest", "write_frame", "write_manifest", "write_stream",
]

cloudpickle.register_pickle_by_value(sys.modules[__name__])
