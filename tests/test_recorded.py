"""A recorded series of 24 frames and what was recorded of it: boundaries, line fits, decay fits, trends."""

import pytest
from pyspark.sql import functions as F

from grainflow.operators import regression as reg
from grainflow.operators import sequence as seq

# Run, train, count, mean size, Sauter mean, coverage of one frame of each train, in the order of time.
SERIES = [
    ("r562", 0, 13, 18.8459197648556, 34.21882368792446, 0.0061775),
    ("r562", 1, 15, 12.74992960319566, 17.089503241314034, 0.00615),
    ("r562", 2, 9, 24.165573520989764, 36.7688052209259, 0.006175),
    ("r562", 3, 8, 25.562549601875915, 37.980176091757784, 0.005185),
    ("r562", 4, 16, 18.057421544288005, 31.71771432449612, 0.00792),
    ("r562", 5, 710, 12.797879640047976, 35.39575243089652, 0.3831825),
    ("r562", 6, 497, 15.735210071208485, 36.35154592657751, 0.3709025),
    ("r562", 7, 411, 17.773068339323107, 36.76951103359296, 0.3658825),
    ("r562", 8, 372, 18.371558008405636, 37.15876482167361, 0.3514),
    ("r563", 0, 301, 19.868478805318347, 38.015457260681615, 0.3314075),
    ("r563", 1, 294, 19.82464815248952, 37.80575362672846, 0.3226225),
    ("r563", 2, 280, 20.00964273101939, 38.261059045149764, 0.3147325),
    ("r563", 3, 250, 21.00669149229872, 39.09071106512339, 0.30859),
    ("r563", 4, 478, 15.24994814577676, 37.51718404563833, 0.3464275),
    ("r563", 5, 406, 16.606865557319843, 37.4426225721231, 0.32846),
    ("r563", 6, 347, 17.40386638032139, 37.706634386545794, 0.316755),
    ("r563", 7, 320, 17.797710990882344, 38.57709402267012, 0.3091025),
    ("r564", 0, 259, 19.18930406564799, 41.74407770049846, 0.294385),
    ("r564", 1, 243, 20.3151541826113, 42.08089552814673, 0.2918575),
    ("r564", 2, 222, 21.031883240032457, 40.89967065987094, 0.2778625),
    ("r564", 3, 421, 14.416477781062978, 32.728375384666265, 0.2823775),
    ("r564", 4, 359, 16.007696948309636, 32.21337639954449, 0.269525),
    ("r564", 5, 302, 17.602253136449683, 34.3529852334503, 0.25758),
    ("r564", 6, 272, 18.07896220846837, 34.12748912232447, 0.2493325),
]
# When each frame was taken, in seconds, and where the runs began.
T_S = [0, 15, 30, 45, 60, 75, 90, 105, 120, 149, 164, 179, 194, 209, 224, 239, 254, 286, 301, 316, 331, 346, 361, 376]
STARTS = [("r562", 0.0), ("r563", 149.0), ("r564", 286.0)]
# Metric and run before a boundary; ratio, typical step within runs, z.
BOUNDARIES = {
    ("n", "r562"): (0.8091397849462365, 1.170028818443804, -1.1894572514684578),
    ("n", "r563"): (0.809375, 1.170028818443804, -1.1863727657108187),
    ("r_mean", "r562"): (1.0814803402208901, 1.088978493472377, 0.5823318186056844),
    ("r_mean", "r563"): (1.0781894410735486, 1.088978493472377, 0.5416818190070488),
    ("r32", "r562"): (1.0230549223882792, 1.0230850525454194, 0.5348804554039835),
    ("r32", "r563"): (1.082094925967395, 1.0230850525454194, 2.5684942021364456),
    ("coverage", "r562"): (0.9431061468412066, 1.033108431461098, -1.1236916595763955),
    ("coverage", "r563"): (0.9523863443356169, 1.033108431461098, -0.7983154448838838),
}
RANGES = [(1, "r562", 5, "r563", 3), (2, "r563", 4, "r564", 2), (3, "r564", 3, "r564", 6)]
# Intercept, its error, slope a second, its error, r2 and p of straight lines through the mean size of each range.
LINES = {
    1: (14.744266786922559, 0.7325436789128416, 0.05763244316119893, 0.010167845242435969, 0.84263304827824, 0.0012973363825060254),
    2: (15.587299115905555, 0.1758099658567017, 0.05050174522200331, 0.0027318284375540437, 0.985580304467811, 8.521554172094615e-06),
    3: (14.639046098019234, 0.3615038845449368, 0.08388006313570812, 0.012882130285286064, 0.9549526041402454, 0.02278323584772379),
}
# n0, tau, n_inf, r2, rmse of decays of the count with an offset, errors of n0 and tau.
DECAYS = {
    1: (701.2813488642421, 27.468724501103956, 267.2014472249023, 0.990122982765071, 14.20553359780758, 17.341635068109728, 3.1396002015901487),
    2: (476.07921708118204, 55.528250822043944, 184.19562736242443, 0.997536277685533, 4.284981508563491, 5.260466547937358, 5.792598307358144),
    3: (421.96224747961367, 49.18183865815993, 168.8509104439421, 0.9972245084057918, 3.0011937784995215, 5.9247550403004405, 19.91370240699479),
}


@pytest.fixture(scope="module")
def line(spark):
    df = spark.createDataFrame(SERIES, "run string, train int, n int, r_mean double, r32 double, coverage double").withColumn("set", F.lit("s"))
    return seq.timeline(df, "run", "train", 15.0, 29.0, spark.createDataFrame(STARTS, "run string, start_s double"), ["set"])


def members(spark, line):
    ranges = spark.createDataFrame(RANGES, "range_id int, start_run string, start_train int, end_run string, end_train int")
    return seq.range_members(line, ranges, "run", "train", "set")


def test_timeline(line):
    assert [(r.seq, r.t_s) for r in line.orderBy("seq").collect()] == list(enumerate(map(float, T_S)))


def test_boundaries(line):
    rows = seq.boundary_jumps(line, "run", ["n", "r_mean", "r32", "coverage"], ["set"]).collect()
    got = {(r.metric, r.from_run): (r.ratio, r.typical_step, r.z) for r in rows}
    assert got.keys() == BOUNDARIES.keys() and all(got[k] == pytest.approx(v, rel=1e-9) for k, v in BOUNDARIES.items())


def test_lines(spark, line):
    rows = {r.range_id: r for r in reg.range_lines(members(spark, line), ["range_id"], "t_s", "r_mean").collect()}
    got = {k: (r.intercept, r.intercept_se, r.slope_per_s, r.slope_se, r.r2, r.p) for k, r in rows.items()}
    assert got.keys() == LINES.keys() and all(got[k] == pytest.approx(v, rel=1e-9) for k, v in LINES.items())


def test_decays(spark, line):
    rows = {r.range_id: r for r in reg.decay_fits(members(spark, line), ["range_id"], "t_s", "n", True).collect()}
    got = {k: (r.n0, r.tau, r.n_inf, r.r2, r.rmse, r.n0_se, r.tau_se) for k, r in rows.items()}
    assert got.keys() == DECAYS.keys() and all(got[k] == pytest.approx(v, rel=1e-4) for k, v in DECAYS.items())


def test_whole_set_trend(line):
    """Recorded: rho of the count +0.28 with p 0.19, of the mean size -0.08 with p 0.72."""
    for metric, rho, p in (("n", 0.28, 0.19), ("r_mean", -0.08, 0.72)):
        r = reg.whole_set_trend(line, "set", "seq", metric).first()
        assert (round(r.rho, 2), round(r.p, 2)) == (rho, p)


# Run, train, count, mean and median size, volume, small share and coverage of another export of the same runs.
COMPARED = [
    ("r562", 5, 448, 16.801496734206186, 13.362177819083863, 29135179.13598125, 0.32589285714285715, 0.372365),
    ("r562", 6, 438, 17.232524109536627, 13.515730426976965, 28771939.538332887, 0.2785388127853881, 0.3745175),
    ("r562", 7, 390, 18.121949430941015, 14.112956721993445, 29097158.26949875, 0.2512820512820513, 0.362035),
    ("r562", 8, 370, 18.42122743726815, 15.098889753604485, 28283292.709919497, 0.21891891891891893, 0.35143),
    ("r563", 0, 319, 19.597461113959618, 16.29317696632769, 27467232.695334908, 0.2006269592476489, 0.3342),
    ("r563", 1, 302, 19.723423260839304, 16.67764032092678, 26283443.894946445, 0.19536423841059603, 0.323135),
    ("r563", 2, 279, 20.09025386179307, 17.148723653289064, 25304506.67758596, 0.17562724014336917, 0.31663),
    ("r563", 3, 256, 20.963947140881285, 17.596374775700973, 25897401.1801214, 0.17578125, 0.310825),
    ("r563", 4, 431, 16.386552591146092, 12.551580498164313, 28356763.283147305, 0.3480278422273782, 0.33862),
    ("r563", 5, 387, 16.88156791055676, 13.584211399035269, 26606360.62887103, 0.32558139534883723, 0.32902),
    ("r563", 6, 345, 17.441830161160947, 14.112018449901672, 24849348.42953333, 0.26666666666666666, 0.3188125),
    ("r563", 7, 330, 17.305937766731343, 13.932722687641387, 24354122.58632964, 0.3, 0.3112175),
    ("r564", 0, 265, 18.921673783627668, 14.988757461430424, 23616700.126843404, 0.22641509433962265, 0.2889025),
    ("r564", 1, 242, 19.883753816632442, 15.98309478882289, 23439855.644382026, 0.21074380165289255, 0.286395),
    ("r564", 2, 231, 20.488074275003154, 16.47004159968097, 23522033.92040555, 0.18181818181818182, 0.2817125),
    ("r564", 3, 395, 15.229223382125, 11.777501663114297, 18247716.924869876, 0.37721518987341773, 0.2794575),
    ("r564", 4, 349, 16.250266126053916, 12.652167182207377, 18783057.099819444, 0.30945558739255014, 0.27029),
    ("r564", 5, 302, 17.494148956633016, 14.277786013723627, 18971317.550945893, 0.24172185430463577, 0.2570425),
    ("r564", 6, 267, 17.890146797577188, 14.48947097266726, 16923351.389596656, 0.23220973782771537, 0.2490475),
]
# Ratios of count, median size and volume, changes of the small share and the coverage, z, kind, flagged and fresh of the step to each train.
STEPS = {
    ("r562", 6): (0.9776785714285714, 1.011491585426576, 0.9875326114882276, -0.04735404435746904, 0.0021525000000000016, 1.1646938326042182, "little change", False, False),
    ("r562", 7): (0.8904109589041096, 1.0441874968018328, 1.0113033301329086, -0.027256761503336835, -0.012482500000000007, 0.6487204251051185, "coalescence", False, False),
    ("r562", 8): (0.9487179487179487, 1.0698601328575306, 0.9720293799125946, -0.032363132363132346, -0.010604999999999976, 0.9859581078887931, "little change", False, False),
    ("r563", 1): (0.9467084639498433, 1.023596586190259, 0.9569017813509287, -0.00526272083705287, -0.011064999999999992, 0.5759456213464368, "little change", False, False),
    ("r563", 2): (0.9238410596026491, 1.0282464019667805, 0.9627546062352694, -0.019736998267226857, -0.006504999999999983, 0.06612909554390588, "little change", False, False),
    ("r563", 3): (0.9175627240143369, 1.0261040489929436, 1.0234303916725083, 0.00015400985663083233, -0.005805000000000005, 0.7730358976067536, "little change", False, False),
    ("r563", 4): (1.68359375, 0.7133049084347151, 1.094965594652551, 0.1722465922273782, 0.02779499999999996, 11.706109124813857, "new bubbles", True, True),
    ("r563", 5): (0.8979118329466357, 1.0822709857951338, 0.938272128000005, -0.02244644687854097, -0.009599999999999997, 1.280602205691362, "coalescence", False, False),
    ("r563", 6): (0.8914728682170543, 1.03885444913673, 0.9339627007298722, -0.05891472868217057, -0.01020749999999998, 1.3762077431258484, "coalescence", False, False),
    ("r563", 7): (0.9565217391304348, 0.9872948180377744, 0.9800708720951767, 0.033333333333333326, -0.007595000000000018, 1.980281079239843, "little change", False, False),
    ("r564", 1): (0.9132075471698113, 1.0663388763178754, 0.9925118885571836, -0.015671292686730093, -0.002507499999999996, 0.9017378862646802, "little change", False, False),
    ("r564", 2): (0.9545454545454546, 1.0304663657002529, 1.0035059207390307, -0.02892561983471073, -0.004682500000000034, 0.7002610938480719, "little change", False, False),
    ("r564", 3): (1.70995670995671, 0.7150863336825105, 0.7757712188757553, 0.1953970080552359, -0.0022549999999999515, 12.007461068213967, "new bubbles", True, True),
    ("r564", 4): (0.8835443037974684, 1.074265794572751, 1.029337378322652, -0.0677596024808676, -0.00916750000000005, 1.6980326074310974, "coalescence", False, False),
    ("r564", 5): (0.8653295128939829, 1.1284854055518918, 1.010022886590078, -0.06773373308791436, -0.013247499999999968, 2.3488202695181246, "coalescence", False, False),
    ("r564", 6): (0.8841059602649006, 1.014826175342603, 0.8920493447094755, -0.009512116476920407, -0.007995000000000002, 0.7865467199460472, "coalescence", False, False),
}
# Rows, rho, its p, slope, its error and p for each run, and for all of them pooled; trains of new layers are left out.
TRENDS = {
    ("n", "r562"): (4, -1.0, 0.0, -0.06899428515828995, 0.012072014552183298, 0.029277112146911977),
    ("n", "r563"): (7, 0.5, 0.2531699951003227, 0.025048943758711775, 0.020339646346424465, 0.2728829897431016),
    ("n", "r564"): (6, 0.5428571428571429, 0.26570262390670546, 0.03136390326282438, 0.0278346112418541, 0.322850294466892),
    ("n", None): (17, 0.3823529411764707, 0.1298634258225738, 0.021122020337509116, 0.015005597990876595, 0.18270656579832525),
    ("r_mean", "r562"): (4, 1.0, 0.0, 0.032643241734995734, 0.00440144629258424, 0.017699201967227178),
    ("r_mean", "r563"): (7, -0.5357142857142858, 0.21521745567801298, -0.025365434427198085, 0.009166821908255832, 0.03950119960335487),
    ("r_mean", "r564"): (6, -0.5428571428571429, 0.26570262390670546, -0.023427875450051986, 0.013932010735124378, 0.16794208261127558),
    ("r_mean", None): (17, -0.5686274509803922, 0.017226738525358574, -0.020757279120893264, 0.007511534583656076, 0.016120086607240593),
    ("frac_small", "r562"): (4, -1.0, 0.0, -0.034817857617515144, 0.00296551966157818, 0.007176338048504925),
    ("frac_small", "r563"): (7, 0.5714285714285715, 0.18020198891152767, 0.018703904529040458, 0.0064287447674790344, 0.03342233160010737),
    ("frac_small", "r564"): (6, 0.5428571428571429, 0.26570262390670546, 0.007392051476504747, 0.008208916973480267, 0.41877358840879175),
    ("frac_small", None): (17, 0.465686274509804, 0.05957824210811781, 0.010882900946963122, 0.005519564823729405, 0.07030812731563599),
}


@pytest.fixture(scope="module")
def compared(spark):
    return spark.createDataFrame(COMPARED, "run string, train int, n int, r_mean double, r_median double, volume double, frac_small double, coverage double")


def test_steps(compared):
    steps = seq.steps(compared, "run", "train", coverage="coverage")
    steps = seq.outlier_steps(steps.withColumn("kind", seq.step_kind(F.col("count_ratio"), F.col("r_mean_ratio"), F.col("volume_ratio"))), "run")
    rows = {(r.run, r.train_to): r for r in steps.collect()}
    assert rows.keys() == STEPS.keys()
    for k, (*numbers, kind, flagged, fresh) in STEPS.items():
        r = rows[k]
        assert (r.count_ratio, r.r_median_ratio, r.volume_ratio, r.frac_small_change, r.coverage_change, r.z) == pytest.approx(tuple(numbers), rel=1e-9)
        assert (r.kind, r.flagged, r.fresh) == (kind, flagged, fresh)
    assert {(r.run, r.train) for r in seq.layer_set(steps, "run").collect()} == {("r563", 4), ("r564", 3)}


def test_trends(spark, compared):
    layers = spark.createDataFrame([("r563", 4), ("r564", 3)], "run string, train int")
    rows = reg.trends(compared, "run", "train", ["n", "r_mean", "frac_small"], ["n", "r_mean"], layers).collect()
    got = {(r.metric, None if r.pooled else r.run): (r.n, r.spearman_rho, r.spearman_p, r.slope, r.slope_se, r.slope_p) for r in rows}
    assert got.keys() == TRENDS.keys() and all(got[k] == pytest.approx(v, rel=1e-8, abs=1e-12) for k, v in TRENDS.items())
