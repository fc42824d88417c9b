import pytest

from rasterloom.functions.codecs import ico
from rasterloom.functions.codecs.base import CodecError, Raster
from rasterloom.functions.options import from_pairs


def test_ico_sizes_must_be_those_of_the_image():
    image = Raster(4, 3, "Rgb8", bytes(36))
    assert ico.encode(image, **from_pairs("ICO", [("sizes", "4x3")])) == ico.encode(image)
    with pytest.raises(CodecError) as e:
        ico.encode(image, **from_pairs("ICO", [("sizes", "3x4")]))
    assert "Parameter" in (e.value.args[0], getattr(e.value, "kind", None), getattr(e.value, "category", None))
