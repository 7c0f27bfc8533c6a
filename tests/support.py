"""Constants that several test files share."""

SF = "/root/testdata/sf0.001"
