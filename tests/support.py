"""Names that several test modules share. They stand here and not in a conftest: the folders have one each, under one module name."""

SF001 = "/root/testdata/sf0.001"
