import lithoflow


def test_public_names():
    for name in lithoflow.__all__:
        assert callable(getattr(lithoflow, name))
