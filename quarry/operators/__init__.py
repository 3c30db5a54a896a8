"""DataFrame-to-DataFrame operators; every one takes its clock as an explicit ``as_of`` argument."""
