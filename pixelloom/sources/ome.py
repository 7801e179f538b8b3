"""OME-XML: built for a writer, read for a listing. Names of elements, attributes and namespace are fixed values."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

NAMESPACE = "http://www.openmicroscopy.org/Schemas/OME/2016-06"
CREATOR = "pixelloom 0.1.0"
INSTRUMENT = "Instrument:StandardBioToolsInstrument"
#: Fixed value: a message that callers match on.
NO_METADATA = "No OME-XML metadata found"


@dataclass
class ImageInfo:
    channels: list[str]
    size_x: int
    size_y: int
    pixel_type: str = "uint16"
    name: str = ""
    image_id: str = "Image:0"
    pixels_id: str = "Pixels:0"
    channel_prefix: str = "Channel:0:"
    physical_x: float = 1.0
    physical_y: float = 1.0
    attributes: dict = field(default_factory=dict)


def to_xml(info: ImageInfo) -> str:
    """The document for one image: one channel and one plane entry a channel, with planes in file order."""
    n = len(info.channels)
    pixels = {
        "ID": info.pixels_id, "DimensionOrder": "XYZCT", "Type": info.pixel_type, "SizeX": info.size_x, "SizeY": info.size_y,
        "SizeZ": 1, "SizeC": n, "SizeT": 1, "PhysicalSizeX": info.physical_x, "PhysicalSizeY": info.physical_y,
    }
    nested = [("Channel", {"ID": f"{info.channel_prefix}{k}", "Name": c, "SamplesPerPixel": 1}) for k, c in enumerate(info.channels)]
    nested += [("TiffData", {"FirstC": k, "FirstZ": 0, "FirstT": 0, "IFD": k, "PlaneCount": 1}) for k in range(n)]
    text = lambda d: {k: str(v) for k, v in d.items()}
    root = ET.Element("OME", {"xmlns": NAMESPACE, "Creator": CREATOR})
    ET.SubElement(root, "Instrument", {"ID": INSTRUMENT})
    holder = ET.SubElement(ET.SubElement(root, "Image", {"ID": info.image_id, "Name": info.name}), "Pixels", text(pixels))
    for tag, d in nested:
        ET.SubElement(holder, tag, text(d))
    ET.indent(root, "  ")
    return ET.tostring(root, encoding="unicode", xml_declaration=True)


def from_xml(xml: str | None) -> ImageInfo:
    """Channels, sizes (0 where missing) and physical sizes (1.0 where missing)."""
    if not xml:
        raise ValueError(NO_METADATA)
    root = ET.fromstring(xml)
    q = f"{{{NAMESPACE}}}"
    pixels = root.find(f".//{q}Pixels")
    if pixels is None:
        raise ValueError(NO_METADATA)
    names = [c.get("Name") for c in root.iter(f"{q}Channel")]
    return ImageInfo(names, int(pixels.get("SizeX", 0)), int(pixels.get("SizeY", 0)), pixels.get("Type", "uint16"), physical_x=float(pixels.get("PhysicalSizeX", 1.0)), physical_y=float(pixels.get("PhysicalSizeY", 1.0)))


def documents(images: DataFrame) -> DataFrame:
    """Adds ``xml``, the document of each row's struct ``image`` (id, name, channel_labels, width, height, pitch, pitch_y), which goes."""

    def run(batches):
        for b in batches:
            made = [to_xml(ImageInfo(i["channel_labels"], i["width"], i["height"], "uint16", i["name"], f"Image:{i['id']}", f"Pixels:{i['id']}", f"Channel:{i['id']}:", i["pitch"], i["pitch_y"])) for i in b.column("image").to_pylist()]
            yield b.drop_columns(["image"]).append_column("xml", pa.array(made, pa.string()))

    rest = images.drop("image")
    return images.mapInArrow(run, StructType([*rest.schema.fields, StructField("xml", StringType())]))
