"""DataFrame operators: cleaning, RFM, segmentation, CLV, reports, tests,
preprocessing and model search."""
