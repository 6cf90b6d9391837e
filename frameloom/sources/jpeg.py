"""JPEG previews through the JVM's ImageIO, one frame at a time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

from . import tiff


def encode(spark: SparkSession, data: np.ndarray, low: float, high: float, gamma: float = 1.0, quality: float = 0.95) -> bytes:
    """8-bit JPEG of planar samples; the same scaling as TIFF."""
    jvm = spark._jvm
    image_io = jvm.javax.imageio.ImageIO
    source = jvm.java.io.ByteArrayInputStream(bytearray(tiff.encode(data, low, high, gamma, 8)))
    image = image_io.read(source)
    writer = image_io.getImageWritersByFormatName("jpeg").next()
    out = jvm.java.io.ByteArrayOutputStream()
    stream = image_io.createImageOutputStream(out)
    writer.setOutput(stream)
    params = writer.getDefaultWriteParam()
    params.setCompressionMode(2)  # MODE_EXPLICIT
    params.setCompressionQuality(float(quality))
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), params)
    stream.close()
    writer.dispose()
    return bytes(out.toByteArray())
