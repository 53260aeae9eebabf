"""Plan-level building blocks shared by operators (prefix sums, sized joins, injector chains)."""
