"""Error names and their categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every error name under its category.
CATEGORIES = {
    "allocation": ["AllocationLimitExceeded", "OutOfMemory"],
    "resource_limit": ["CanvasTooLarge", "ChunkTooLarge", "DimensionsOverflow", "FileTooLarge", "FrameCountTooLarge", "InputTooLarge", "InvalidCanvasSize", "OutputTooLarge", "TooManyChunks"],
    "bitstream": ["InvalidBitCount", "InvalidHuffmanCode", "InvalidHuffmanTree", "InvalidVP8Header", "InvalidVP8LHeader", "InvalidVP8LImageData", "InvalidVP8LTransform", "TruncatedBitstream"],
    "unsupported": ["UnsupportedAlphaCompression", "UnsupportedAnimationDecode", "UnsupportedAnimationMux", "UnsupportedImageFormat", "UnsupportedVP8LImageData"],
    "container": [
        "CorpusUnavailable", "DuplicateChunk", "DuplicateImageData", "DuplicateMetadata", "InputTooSmall", "InvalidAlphaChunk", "InvalidAnimationChunk", "InvalidChunkOrder", "InvalidChunkPadding",
        "InvalidCorpusPath", "InvalidExtendedHeaderReservedBits", "InvalidExtendedHeaderSize", "InvalidFeatureFlags", "InvalidFrameChunk", "InvalidMuxChunk", "InvalidRiffSignature", "InvalidRiffSize",
        "InvalidSimpleChunk", "InvalidWebPSignature", "MissingAnimationControl", "MissingExtendedHeader", "MissingImageData", "MissingRequiredChunk", "TrailingData", "TruncatedChunkHeader", "TruncatedChunkPayload",
    ],
}


def category(error: Column) -> Column:
    """The category of an error name; null for null."""
    out = None
    for name, errors in CATEGORIES.items():
        out = (F if out is None else out).when(error.isin(errors), name)
    return out


class ImageError(Exception):
    """What a kernel found wrong; becomes a status row, never a failed task."""

    def __init__(self, name: str):
        super().__init__(name)
        self.name = name
