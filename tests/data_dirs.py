"""Folders of the driver's test tables; a module of its own name, so that no other conftest shadows it."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
